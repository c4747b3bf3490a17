"""Check the queries of some plan modules: python tools/check_module.py folder module ..."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import check  # noqa: E402

from importlib import import_module  # noqa: E402

names = [q for m in sys.argv[2:] for q in import_module(f"urbanflow.plans.{m}").QUERIES]
sys.exit(1 if check.main([sys.argv[1], *names]) else 0)
