import sys

from sparkmarts.cli import main

if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
