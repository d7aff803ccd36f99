"""check_oracle for one registry area: check_area.py AREA [sf_dir] [name-substring ...]"""
import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import check_oracle  # noqa: E402

area = importlib.import_module(f"corpuslens.plans.{sys.argv.pop(1)}")


class Area:
    queries = staticmethod(lambda: area.QUERIES)
    oracle_sql = staticmethod(lambda: area.ORACLE)


check_oracle.entry = Area
sys.exit(check_oracle.main())
