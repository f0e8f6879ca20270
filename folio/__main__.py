import sys

from folio.cli import main

sys.exit(main())
