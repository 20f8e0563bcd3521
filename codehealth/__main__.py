import sys

from codehealth.plans.cli import main

sys.exit(main(sys.argv[1:]))
