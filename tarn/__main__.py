from tarn.cli import main

raise SystemExit(main())
