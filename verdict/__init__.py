"""Build, verify and measure corpora of programming problems with executable tests, on Spark."""
