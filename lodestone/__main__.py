import sys

from lodestone.plans.cli import main

sys.exit(main())
