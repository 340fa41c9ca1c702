from hotspot.cli import main

main()
