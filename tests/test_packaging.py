"""The library without its optional parts, and workers without the library."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def run(code: str, folder: Path) -> str:
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


def test_entry_without_the_optional_folders(tmp_path):
    for name in ("trawl", "tests"):
        shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(REPO / name, tmp_path / name)
    count = "import __spark_entry__ as e; q = e.queries(); assert 'ingest' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    run(count, tmp_path)
    if (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path / "corpus_pipeline.py")
        run(count, tmp_path)


def test_workers_need_no_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from trawl.session import local_session
from trawl.operators import chunks, pages, versions
spark = local_session(1, 1)
p = spark.createDataFrame([("s", "d", i, f"Page {{i}} begins. " + "One two. Three! " * 300) for i in range(3)], "session_id string, doc_name string, page int, text string")
assert chunks.chunk_pages(pages.clean_pages(p), 100, 10).count() > 3
assert pages.document_digests(p).count() == 1
assert chunks.split_pages(p, 100, 10, semantic=False).count() > 3
"""
    run(code, tmp_path)
