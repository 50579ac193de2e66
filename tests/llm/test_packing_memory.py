"""A worker that packs doesn't take much more memory than the units that it keeps."""

import subprocess
import sys

_RUN = """
import random, resource
from marginalia.llm import tokenization
own = tokenization.encoder(tokenization.vocabulary("byte_bpe_50k.json"))
own.encode(["a few words."])
rng = random.Random(3)
texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(400)) for _ in range(512)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
own.encode(texts)
print(len(own.units), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_new_units_take_little_memory():
    units, mb = map(int, subprocess.run([sys.executable, "-c", _RUN], capture_output=True, text=True, check=True).stdout.split())
    assert units > 200_000 and mb < 150
