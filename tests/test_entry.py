"""The registered queries without the text operators, or without a library that these need."""

from __future__ import annotations

import subprocess
import sys

import pytest

CODE = """
import sys, warnings
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as contract
from oracles.retail import oracle_sql
assert set(contract.queries()) == set(contract.oracle_sql()) == set(oracle_sql()), set(contract.queries()) ^ set(oracle_sql())
"""


@pytest.mark.parametrize(
    "names", [["corpus_pipeline"], ["monthweave.llm"], ["sentencepiece"], ["public_tokenizers"], ["regex", "tiktoken"]]
)
def test_other_queries_stay(names):
    import __spark_entry__ as contract

    folder = contract.__file__.rsplit("/", 1)[0]
    done = subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=folder, capture_output=True, text=True, timeout=120)
    if contract.texts is None:
        pytest.skip("there are no text operators")
    assert done.returncode == 0, done.stderr
