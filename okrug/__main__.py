import sys

from okrug.cli import main

sys.exit(main())
