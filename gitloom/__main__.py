import sys

from gitloom.cli import main

sys.exit(main())
