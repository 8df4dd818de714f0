import sys

from spanframe.cli import main

sys.exit(main())
