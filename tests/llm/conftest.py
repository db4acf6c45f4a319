import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# Tests import this from whichever conftest was loaded last.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
