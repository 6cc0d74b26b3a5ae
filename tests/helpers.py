"""Generators and in-memory files for the tests."""

import io
import os

from chunkwell.functions import varint as V
from chunkwell.sources.chunks import Input, records


class Bytes:
    """A file in memory."""

    def __init__(self, data):
        self.file, self.n = io.BytesIO(data), len(data)

    def size(self):
        return self.n

    def seek(self, pos):
        self.file.seek(pos)

    def read(self, n):
        return self.file.read(n)


def rows_of(data, **options):
    return [r for _, found, _ in records(Input(Bytes(data)), **options) for r in found.to_pylist()]


def random_message(rng, depth=0):
    out = b""
    for _ in range(rng.randrange(5)):
        wire, number = rng.choice([0, 1, 2, 5, 3] if depth < 3 else [0, 1, 2, 5]), rng.randrange(1, 40)
        tag = V.encode_u64(number << 3 | wire)
        if wire == 0:
            out += tag + V.encode_u64(rng.getrandbits(rng.randint(1, 64)))
        elif wire == 1:
            out += tag + os.urandom(8)
        elif wire == 5:
            out += tag + os.urandom(4)
        elif wire == 2:
            inner = os.urandom(rng.randrange(6)) if rng.random() < 0.5 else random_message(rng, depth + 1)
            out += tag + V.encode_u64(len(inner)) + inner
        else:
            out += tag + random_message(rng, depth + 1) + V.encode_u64(number << 3 | 4)
    return out
