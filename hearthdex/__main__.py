import sys

from hearthdex.cli import main

sys.exit(main())
