from agreemill.cli import main

raise SystemExit(main())
