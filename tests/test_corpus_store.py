"""Maintained corpus statistics equal those of the chunks that are left."""

import random

from trawl.operators import bm25
from trawl.sources.corpus_store import CorpusStore

CHUNK = "scope string, chunk_key bigint, text string"


def test_any_sequence_of_changes(spark, tmp_path):
    rng = random.Random(4)
    store, there, key = CorpusStore(spark, f"{tmp_path}/c"), {}, 0
    for batch in range(3):
        added = []
        for _ in range(12):
            added.append((rng.choice("ab"), key, rng.choice(["", " ".join(rng.choice("pqrst") + rng.choice("xy") for _ in range(rng.randrange(9)))])))
            key += 1
        gone = [there.pop(k) for k in rng.sample(sorted(there), len(there) // 2)]
        if batch == 2:
            gone += [there.pop(k) for k in sorted(there) if there[k][0] == "a"]
            added = [c for c in added if c[0] == "b"]
        there |= {c[1]: c for c in added}
        for _ in range(1 + (batch == 1)):  # a repeated batch replaces itself
            store.apply(batch, spark.createDataFrame(added, CHUNK), spark.createDataFrame(gone, CHUNK) if gone else None)
    left = spark.createDataFrame(list(there.values()), CHUNK)
    frequency = bm25.term_document_frequency(bm25.chunk_terms(left))
    rows = lambda df, *names: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())
    folded = CorpusStore(spark, f"{tmp_path}/f")
    store.fold(folded)
    for s in (store, folded):
        assert rows(s.frequency(), "scope", "term", "df", "cf") == rows(frequency, "scope", "term", "df", "cf")
        names = ["scope", "n_chunks", "n_terms", "n_distinct_terms", "mean_idf", "avg_len"]
        assert rows(s.stats(), *names) == rows(bm25.corpus_stats(left, frequency), *names)
