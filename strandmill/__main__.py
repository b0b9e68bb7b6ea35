import sys

from .mapper import main

sys.exit(main())
