import sys

from skyfold.plans.flows import main

sys.exit(main())
