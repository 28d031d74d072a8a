"""Streamed ingest gives the rows of one ingest, however pages fall into micro-batches."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row

from trawl.plans import steps
from trawl.session import staged
from trawl.sources.registry_store import RegistryStore
from trawl.streaming.documents import DocumentStream, PageTracker

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = "session_id string, doc_name string, page bigint, text string"
FILE = "session_id string, doc_name string, reg bigint, file_hash string, upload_timestamp double, page_count bigint"
MANIFEST = "session_id string, doc string, pages bigint, chunks bigint, status string, message string, upload_timestamp double, document_status string, version bigint"
PAYLOAD = "content_hash string, upload_timestamp double, page_count bigint"


def embed(batch):
    return [[float(len(t)), float(len(t.split())), 1.0] for t in batch]


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts, files = {}, []
    for reg in range(7):
        session, name = "st"[reg % 3 == 2], f"f{reg}.pdf"
        n = rng.choice([1, 2, 4])
        if reg in (3, 6):  # nearly the text of an earlier one
            source = [t for (s, d, _), t in texts.items() if d == "f1.pdf"]
            pages = [t + (" tail" if i == 0 else "") for i, t in enumerate(source)]
        else:
            pages = ["Header\n" + " ".join(rng.choice(words) for _ in range(150)) + ". End\nFooter" for _ in range(n)]
        texts |= {(session, name, i + 1): t for i, t in enumerate(pages)}
        files.append((session, name, reg, f"h{reg}", 1000.0 + reg, len(pages)))
    return texts, files


def rows(df, *drop):
    names = sorted(set(df.columns) - set(drop))
    return sorted(str([r[n] for n in names]) for r in df.collect())


@pytest.mark.parametrize("seed", [1])
def test_same_rows_as_one_ingest(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts, files = made(seed)
    pages = [(*k, t) for k, t in texts.items()]
    rng.shuffle(pages)
    pages.sort(key=lambda p: p[1] not in ("f0.pdf", "f1.pdf"))  # these are complete in the first part
    files_df = spark.createDataFrame(files, FILE)
    manifest = spark.createDataFrame([("s", "f4.pdf", 1, 1, "new", "", 5.0, "active", 1)], MANIFEST)
    cache = spark.createDataFrame([], "k string, dim int, vec array<float>")
    whole = steps.ingest(spark.createDataFrame(pages, PAGE), files_df.drop("page_count"), None, manifest, cache, embed, size=60, overlap=10)
    store = RegistryStore(spark, f"{tmp_path}/registry", buckets=2, payload=PAYLOAD)
    stream = DocumentStream(spark, f"{tmp_path}/tables", files_df, store, manifest, cache, embed, size=60, overlap=10)
    cut = len(pages) // 2 + 1
    for i, part in enumerate((pages[:cut], pages[cut:] + pages[:1])):
        spark.createDataFrame(part, PAGE).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        source = spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in/p*")
        stream.start(source, f"{tmp_path}/checkpoint").awaitTermination(100)
    got = stream.tables()
    assert spark.read.parquet(f"{tmp_path}/tables/done").select("batch").distinct().count() == 2
    for name in ("chunks", "results", "manifest", "skipped", "cache", "statistics"):
        mine, other = getattr(got, name), getattr(whole, name)
        same = [c for c in other.columns if c in mine.columns]
        assert rows(mine.select(*same), "message") == rows(other.select(*same), "message"), name
        assert len(same) >= len(other.columns) - 1, (name, mine.columns, other.columns)
    columns = ["session_id", "reg", "doc_id", "version", "result", "message", "matched_reg", "status", "superseded_by", "content_hash"]
    assert rows(got.registry.select(*columns)) == rows(whole.registry.select(*columns))
    assert stream.stale().count() == 0


def test_open_documents_wait_and_stale_ones_go(spark, tmp_path):
    files = [("s", "a.pdf", 0, "a", 1.0, 2), ("s", "b.pdf", 1, "b", 2.0, 1)]
    store = RegistryStore(spark, f"{tmp_path}/registry", buckets=2, payload=PAYLOAD)
    empty = spark.createDataFrame([], MANIFEST), spark.createDataFrame([], "k string, dim int, vec array<float>")
    stream = DocumentStream(spark, f"{tmp_path}/t", spark.createDataFrame(files, FILE), store, *empty, embed, patience_ms=1)

    def push(i, rows):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        stream.start(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in/p*"), f"{tmp_path}/cp").awaitTermination(100)

    push(0, [("s", "a.pdf", 1, "one page of two"), ("s", "b.pdf", 1, "the whole of b")])
    assert spark.read.parquet(f"{tmp_path}/t/done").count() == 0  # b waits for a
    push(1, [("s", "b.pdf", 1, "b again")])
    assert [r.doc_name for r in stream.stale().collect() if r.doc_name == "a.pdf"] == ["a.pdf"]
    assert [r.doc_name for r in spark.read.parquet(f"{tmp_path}/t/done").collect()] == ["b.pdf"]
    assert [r.text for r in stream.tables().chunks.collect()] == ["the whole of b"]
    assert [tuple(r) for r in stream.repeated_pages().collect()] == [("s", "b.pdf", 1)]


class Handle:
    """State of one key in a dict; counts the looks into it."""

    def __init__(self):
        self.kept, self.looks, self.timers = {}, 0, set()

    def getMapState(self, name, *_):
        return State(self, name)

    getValueState = getMapState
    registerTimer = property(lambda self: self.timers.add)
    deleteTimer = property(lambda self: self.timers.discard)


class State:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _look(self):
        self.handle.looks += 1
        return self.handle.kept

    def containsKey(self, key):
        return (self.name, key) in self._look()

    def getValue(self, key):
        return self._look()[self.name, key]

    def updateValue(self, key, value):
        self._look()[self.name, key] = value

    def exists(self):
        return self.name in self._look()

    def get(self):
        return self._look()[self.name]

    def update(self, value):
        self._look()[self.name] = value

    def clear(self):
        kept = self._look()
        for key in [k for k in kept if k == self.name or k[0] == self.name]:
            del kept[key]


class Clock:
    def getCurrentProcessingTimeInMs(self):
        return 5


def test_state_is_read_by_blocks_of_pages_not_by_page():
    rng = random.Random(8)
    numbers = [*range(-9000, 30_000), None]
    rng.shuffle(numbers)
    tracker, handle, kinds = PageTracker(10), Handle(), []
    tracker.init(handle)
    for part in (numbers[:20_000] + numbers[:50], numbers[10_000:10_100] + numbers[20_000:]):
        page_rows = iter([Row(page=p, text="t", page_count=len(numbers)) for p in part])
        kinds.append([(r.kind, r.page) for r in tracker.handleInputRows(("s", "d"), page_rows, Clock())])
    first, second = ([x for x in k if x[0] != "page"] for k in kinds)
    assert first == [("again", p) for p in numbers[:50]]
    assert second == [*(("again", p) for p in numbers[10_000:10_100]), ("complete", None)]
    assert sum(k == "page" for part in kinds for k, _ in part) == len(numbers)
    assert not handle.kept and not handle.timers and handle.looks < 80


def test_texts_stay_in_the_log_and_the_chunks_only(spark, tmp_path):
    """Cleaned pages and chunks without vectors are gone after the micro-batch that made them."""
    texts, files = made(3)
    manifest = spark.createDataFrame([], MANIFEST)
    cache = spark.createDataFrame([], "k string, dim int, vec array<float>")
    store = RegistryStore(spark, f"{tmp_path}/registry", buckets=2, payload=PAYLOAD)
    stream = DocumentStream(spark, f"{tmp_path}/tables", spark.createDataFrame(files, FILE), store, manifest, cache, embed, size=60, overlap=10)
    spark.createDataFrame([(*k, t) for k, t in texts.items()], PAGE).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = staged(spark)
    stream.start(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint").awaitTermination(100)
    assert stream.tables().manifest.count() == len(files)
    left = {f.relative_to(f"{tmp_path}/tables").parts[0] for f in (tmp_path / "tables").rglob("*.parquet")}
    assert left == {"events", "arrivals", "done", "results", "chunks", "cache", "manifest"}
    kept = [spark.read.parquet(n).columns for n in staged(spark) if n not in before]
    assert not [c for c in kept if "text" in c]
