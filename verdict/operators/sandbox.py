"""Untrusted programs in processes of their own, forked from an interpreter that has started already.

A ``Sandbox`` belongs to one task. Its server is a small interpreter in isolated mode that gets a request with three pipes
and forks. The child has a session of its own; its limits, its folder and its environment are set before any line of the
program runs; then it runs as the main module. The server waits, kills what the program has left in its session, and
tells the status. Starting an interpreter takes 20 to 70 ms a case; a fork takes two.

The time limit is kept by the task, which kills the whole session when it is over; a limit of CPU seconds beyond it is
set in the child too, for the case that the task itself is lost. Output is read up to a cap.
"""

from __future__ import annotations

import json
import os
import selectors
import signal
import socket
import subprocess
import sys
import tempfile
import time
from typing import NamedTuple

#: Runs in the server; in the child that it forks, the program becomes the main module.
SERVER = r'''
import atexit, builtins, gc, json, os, resource, runpy, signal, socket, sys, types

def forked(control):
    """Serves until the other side is gone. Returns in children only, with the request."""
    while True:
        data, pipes, _, _ = socket.recv_fds(control, 1 << 16, 3)
        if not data:
            os._exit(0)
        request = json.loads(data)
        pid = os.fork()
        if not pid:
            control.close()
            os.setsid()
            for place, pipe in enumerate(pipes):
                os.dup2(pipe, place)
                os.close(pipe)
            for name, most in request["limits"].items():
                resource.setrlimit(getattr(resource, name), (most, most))
            os.chdir(request["folder"])
            os.environ.update(HOME=request["folder"], TMPDIR=request["folder"])
            return request
        for pipe in pipes:
            os.close(pipe)
        control.send(str(pid).encode())
        os.waitid(os.P_PID, pid, os.WEXITED | os.WNOWAIT)
        try:
            os.killpg(pid, signal.SIGKILL)
        except (ProcessLookupError, PermissionError):
            pass
        control.send(str(os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])).encode())

def ran(main):
    """Runs the file as the main module; the exit status that the interpreter would give."""
    try:
        with open(sys.argv[0], "rb") as f:
            code = compile(f.read(), sys.argv[0], "exec", dont_inherit=True)
        exec(code, main.__dict__)
    except SystemExit as e:
        if e.code is None or isinstance(e.code, int):
            return (e.code or 0) & 255
        print(e.code, file=sys.stderr)
        return 1
    except BaseException as e:
        trace = e.__traceback__ and e.__traceback__.tb_next  # without the frame of this function
        sys.excepthook(type(e), e.with_traceback(trace), trace)
        return 1
    return 0

def program(request):
    """What the end of an interpreter does for a program is done here: threads are joined, exit functions run, names dropped
    and streams flushed. The interpreter's own memory is not taken apart, which costs ten times as much as the fork."""
    sys.argv = request["argv"]
    main = types.ModuleType("__main__")
    main.__dict__.update(__file__=sys.argv[0], __builtins__=builtins)
    sys.modules["__main__"] = main
    status = ran(main)
    try:
        if "threading" in sys.modules:
            sys.modules["threading"]._shutdown()
        atexit._run_exitfuncs()
        main.__dict__.clear()
        for stream in (sys.stdout, sys.stderr):
            if stream is not None and not stream.closed:
                stream.flush()
    except BaseException:
        status = status or 120
    os._exit(status)

gc.freeze()
program(forked(socket.socket(fileno=int(sys.argv[1]))))
'''

#: Calls a function of the program with JSON arguments from standard input and writes its result as JSON.
HARNESS = '''
import json, runpy, sys

def target(names, wanted):
    """A global function, else a method of class Solution, else one of any class that takes no arguments."""
    owners = [names.get("Solution"), *names.values()]
    if callable(names.get(wanted)):
        return names[wanted]
    for owner in owners:
        if isinstance(owner, type):
            try:
                found = getattr(owner(), wanted, None)
            except TypeError:
                continue
            if callable(found):
                return found
    raise AttributeError("no such entry point: " + wanted)

call = target(runpy.run_path(sys.argv[1]), sys.argv[2])
text = sys.stdin.read().strip()
given = json.loads(text) if text else []
value = call(*(given if isinstance(given, list) else [given]))
sys.stdout.write(json.dumps(value, ensure_ascii=False, sort_keys=True))
'''
#: CPU seconds that a program may take beyond its time limit, in case nobody is left to stop it.
SPARE_SECONDS = 10


class Outcome(NamedTuple):
    stdout: bytes
    stderr: bytes
    status: int | None  # None after a time-out; negative for signals
    truncated: bool


class Sandbox:
    """Runs programs one after the other, each in a child of its own. ``close`` ends the server."""

    def __init__(self, max_output_bytes: int = 1_000_000) -> None:
        self.cap, self.server, self.control = max_output_bytes, None, None
        self.folder: tempfile.TemporaryDirectory | None = None
        self.loaded: tuple[str, str] | None = None

    def __enter__(self) -> Sandbox:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.control is not None:
            self.control.close()
            try:
                self.server.wait(1)
            except subprocess.TimeoutExpired:
                self.server.kill()
                self.server.wait()
            self.control = None
        if self.folder is not None:
            self.folder.cleanup()
            self.folder, self.loaded = None, None

    def _start(self) -> None:
        here, there = socket.socketpair(socket.AF_UNIX, socket.SOCK_SEQPACKET)
        env = {"PATH": os.environ.get("PATH", ""), "LANG": "C.UTF-8"}
        with there:
            self.server = subprocess.Popen([sys.executable, "-I", "-c", SERVER, str(there.fileno())], pass_fds=[there.fileno()], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        self.control = here

    def load(self, code: str, entry_point: str = "") -> None:
        """Writes the program into a scratch folder of its own, unless it is there already."""
        if self.loaded == (code, entry_point):
            return
        if self.folder is not None:
            self.folder.cleanup()
        self.folder, self.loaded = tempfile.TemporaryDirectory(prefix="verdict-", ignore_cleanup_errors=True), (code, entry_point)
        for name, text in (("main.py", code), *([("harness.py", HARNESS)] if entry_point else [])):
            with open(os.path.join(self.folder.name, name), "w", encoding="utf-8", errors="surrogatepass") as f:
                f.write(text)

    def run(self, stdin: bytes, timeout: float, memory_mb: int | None = None) -> Outcome:
        """The loaded program on one input. A server that a program has killed is started anew."""
        if self.control is None:
            self._start()
        folder = self.folder.name
        script, entry_point = os.path.join(folder, "main.py"), self.loaded[1]
        argv = [os.path.join(folder, "harness.py"), script, entry_point] if entry_point else [script]
        limits = {"RLIMIT_CORE": 0, "RLIMIT_CPU": int(timeout) + SPARE_SECONDS} | ({"RLIMIT_AS": memory_mb << 20} if memory_mb else {})
        (read_in, write_in), (read_out, write_out), (read_err, write_err) = os.pipe(), os.pipe(), os.pipe()
        deadline = time.monotonic() + timeout
        try:
            socket.send_fds(self.control, [json.dumps({"argv": argv, "folder": folder, "limits": limits}).encode()], [read_in, write_out, write_err])
            pid = int(self.control.recv(64) or 0)
        except (BrokenPipeError, ConnectionResetError):
            pid = 0
        for fd in (read_in, write_out, write_err):
            os.close(fd)
        kept, over, status, pending = {read_out: bytearray(), read_err: bytearray()}, False, None, memoryview(stdin)
        with selectors.DefaultSelector() as ready:
            for fd in (write_in, *kept):
                os.set_blocking(fd, False)
                ready.register(fd, selectors.EVENT_WRITE if fd == write_in else selectors.EVENT_READ)
            ready.register(self.control, selectors.EVENT_READ)
            while pid and ready.get_map() and (left := deadline - time.monotonic()) > 0:
                for key, _ in ready.select(left):
                    fd = key.fileobj
                    if fd is self.control:
                        status = self._status()
                        ready.unregister(fd)
                    elif fd == write_in:
                        try:
                            pending = pending[os.write(fd, pending[:65_536]) :] if pending else pending
                        except BlockingIOError:
                            continue
                        except BrokenPipeError:
                            pending = memoryview(b"")
                        if not pending:
                            ready.unregister(fd)
                            os.close(fd)
                            write_in = -1
                    else:
                        chunk = os.read(fd, 65_536)
                        if not chunk:
                            ready.unregister(fd)
                            continue
                        room = self.cap - len(kept[fd])
                        over |= fd == read_out and len(chunk) > room
                        kept[fd] += chunk[: max(0, room)]
        ended = status is not None
        if pid and not ended:
            for kill in (os.killpg, os.kill):  # the child may not have its session yet
                try:
                    kill(pid, signal.SIGKILL)
                except (ProcessLookupError, PermissionError):
                    pass
            self._status()
        if not pid:  # no server to fork: as if killed
            self.close_control()
            ended, status = True, -signal.SIGKILL
        for fd in (write_in, read_out, read_err):
            if fd >= 0:
                os.close(fd)
        return Outcome(bytes(kept[read_out]), bytes(kept[read_err]), status if ended else None, over)

    def _status(self) -> int:
        try:
            told = self.control.recv(64)
        except ConnectionResetError:
            told = b""
        if not told:
            self.close_control()
        return int(told or -signal.SIGKILL)

    def close_control(self) -> None:
        if self.control is not None:
            self.control.close()
            self.server.kill()
            self.server.wait()
            self.control = None
