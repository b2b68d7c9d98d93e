import sys

from orthant.plans.run import main

sys.exit(main())
