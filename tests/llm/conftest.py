import sys
from pathlib import Path

sys.path.append(str(Path(__file__).resolve().parent))  # the folder is a package: its modules' names may occur beside it too
