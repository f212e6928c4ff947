"""The command line, as spark-submit starts it."""

import sys

from graphmill.cli import main

if __name__ == "__main__":
    sys.exit(main())
