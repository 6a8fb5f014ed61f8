import sys

from lexward.cli import main

sys.exit(main())
