import sys

from kinsieve.cli import main

sys.exit(main())
