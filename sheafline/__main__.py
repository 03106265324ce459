import sys

from .plans.pipeline import main

sys.exit(main())
