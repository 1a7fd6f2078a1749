"""The entry point without the corpus subpackage or a library that only it needs."""

import subprocess
import sys

import pytest

PROBE = """
import sys, warnings
warnings.simplefilter("ignore")
sys.modules[{name!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.QUERIES) <= names and set(entry.ORACLE) <= set(entry.oracle_sql())
print(len(entry.QUERIES), len(names))
"""

ABSENT = ["refrank.llm", "corpus_pipeline", "ahocorasick", "sentencepiece", "tiktoken", "xxhash", "zstandard", "regex", "public_tokenizers"]


@pytest.mark.parametrize("name", ABSENT)
def test_entry_without(name):
    out = subprocess.run([sys.executable, "-c", PROBE.format(name=name)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    own, every = map(int, out.stdout.split()[-2:])
    assert own >= 62 and every >= own
    if name in ("refrank.llm", "corpus_pipeline"):
        assert every == own
