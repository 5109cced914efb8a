"""What the packer encodes together is small."""

import pyarrow as pa

from cytoloom.llm import packing, shared


def test_texts_are_encoded_half_a_megabyte_at_a_time():
    texts = pa.array(["word " * 2000] * 500 + ["word " * 300_000])
    sizes = [sum(len(t.as_py()) for t in some) for some in shared.groups(texts, packing.GROUP)]
    assert sum(sizes) == 500 * 10_000 + 1_500_000 and max(sizes[:-1]) <= (1 << 19) + 10_000
