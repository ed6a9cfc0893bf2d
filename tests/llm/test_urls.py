import random
import re

from verdict.llm.url_filters import Automaton, Rule, judge, parts


def as_regex(glob):
    return re.compile("(?s)" + "".join("[^/]*" if p == "*" else ".*" if p == "**" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]", glob)) + r"\Z")


def test_automaton_against_regex():
    rng = random.Random(3)
    for _ in range(60):
        globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 30))]
        globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
        urls = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 14))) for _ in range(40)]
        found = Automaton(globs).matches([u.encode() for u in urls])
        for u, row in zip(urls, found):
            assert [bool(x) for x in row] == [bool(as_regex(g).match(u)) for g in globs], (u, globs)


def test_parts():
    assert parts("HTTP://WWW.Example.org/EN/1?x#y") == ("www.example.org", "/EN/1")
    assert parts("a://h?/x") == ("h", "")
    assert parts("a://h#/x") == ("h", "")
    assert parts(None) == parts("") == parts("x.org/") == ("", "")


def test_judge(spark):
    rules = [Rule("allow", "org", "/"), Rule("block", "example.org", "/en/1")]
    urls = ["http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/en/1", "http://x.net/a.org/", "http://casino-win.net/", "http://ORG/", "http://x.org", None, "", "x" * 50_000, "http://é.org/" + "y" * 9_000]
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge(pages, rules).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("org/", "allow"), 2: ("org/", "allow"), 3: (None, "allow"), 4: (None, "block"), 5: ("org/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: ("org/", "allow")}
    assert judge(pages.limit(0), rules).count() == 0
