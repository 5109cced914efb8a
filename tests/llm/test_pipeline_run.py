"""The whole pipeline over real rows, to the packed sequences."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cytoloom.llm.queries import TOKENIZER

D = "/root/testdata/sf0.001"


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    secret = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("The key of the house was password = hunter2hunter2 and the road to the sea was long in the morning of that day.")})
    docs.union(secret).union(docs.limit(0)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    tokenizer = Tokenizer.from_file(TOKENIZER)
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    for doc, own in pieces.items():
        total = own[0].doc_tokens
        covered = Counter()
        for r in own:
            covered.update(range(r.start, r.start + r.length))
        assert set(covered) == set(range(total)) and len(set(covered.values())) == 1  # every copy is whole
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted({r.start: r for r in own}.values(), key=lambda r: r.start)])
        if len(set(r.start for r in own)) * covered[0] == len(own) and sum(r.length for r in {r.start: r for r in own}.values()) == total:
            assert ids[-1] == 2
            if doc != 10**6 and "[SECRET]" not in (text := tokenizer.decode(ids[:-1].tolist(), skip_special_tokens=False)):
                assert ids[:-1].tolist() == tokenizer.encode(kept[doc], add_special_tokens=False).ids, text[:80]
            elif doc == 10**6:
                assert "hunter2hunter2" not in tokenizer.decode(ids[:-1].tolist(), skip_special_tokens=False)
    near = defaultdict(set)
    for doc in pieces:
        near[kept[doc]].add(doc)
    assert all(len(x) == 1 for x in near.values()) and None not in near and len(pieces) > 0.5 * len(near)
    assert not {d for d, t in kept.items() if not any(map(str.isalpha, t or ""))} & set(pieces)
