from orrery.cli import main

main()
