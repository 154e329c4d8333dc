import subprocess
import sys

import __spark_entry__ as E

BLOCKED = """
import sys

class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == sys.argv[1] or name == sys.argv[1]:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Block())
import __spark_entry__ as E
print(len(E.queries()), len(E.oracle_sql()))
"""


def test_engine_stands_without_the_training_operators_and_what_they_need():
    from verdigris.plans.queries import QUERIES

    for name in ("tiktoken", "verdigris.llm"):
        out = subprocess.run([sys.executable, "-c", BLOCKED, name], capture_output=True, text=True, timeout=120, check=True).stdout.split()
        assert out == [str(len(QUERIES))] * 2


def test_every_engine_query_has_sql():
    assert set(E.queries()) >= set(E.oracle_sql())
