import hashlib
import os

from pyspark.sql import functions as F

from codeaudit.operators import manifests as M
from codeaudit.plans.verify import register_dataset
from codeaudit.session import checkpoint
from codeaudit.sources import corpus


def test_files_of_any_name_are_read(spark, tmp_path):
    files = {"p/pkg/__init__.py": "import os\n", "p/.env": "A=1\n", "p/src/é.py": "x = 'ü'\n", "p/_hidden/a.js": "var a = 1;\n",
             "q/node_modules/x.js": "skipped", "q/pic.png": "skipped", "q/main.ts": "let a;\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "q/broken.py").write_bytes(b"\xff\xfe")
    os.symlink(tmp_path / "q/main.ts", tmp_path / "q/link.ts")
    for source in (str(tmp_path), f"file://{tmp_path}"):
        got = {(r.project_id, r.path): r.content for r in corpus.read_corpus(spark, source).collect()}
        assert got == {**{tuple(n.split("/", 1)): t for n, t in files.items() if t != "skipped"}, ("q", "broken.py"): "��"}


def test_large_sparse_and_unreadable_files_are_hashed_as_streams(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "_small").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    os.symlink("nowhere", tmp_path / "dangling")
    got = {r.path: r for r in corpus.hash_files(spark, str(tmp_path)).selectExpr(
        "path", "size", "sha256", "length(head) AS head", "file_type", "read_error").collect()}
    zeros = hashlib.sha256()
    for _ in range(3 << 10):
        zeros.update(bytes(1 << 20))
    assert (got["big.bin"].size, got["big.bin"].sha256, got["big.bin"].head) == (3 << 30, zeros.hexdigest(), corpus.HEAD_BYTES)
    assert (got["_small"].sha256, got["empty"].sha256) == (hashlib.sha256(b"abc").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert got["dangling"].file_type == "symlink" and got["dangling"].sha256 is None
    missing = corpus.list_files(spark, str(tmp_path / "absent")).collect()
    assert len(missing) == 1 and missing[0].read_error


def test_register_and_verify_what_was_hashed(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"d{i % 7}"
        folder.mkdir(exist_ok=True)
        (folder / f"_f{i}.csv").write_text(str(i))
    keyed = lambda df: df.select(F.lit("s").alias("store_id"), F.lit("d").alias("name"), F.lit("1").alias("version"), "*")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    registered = checkpoint(keyed(corpus.hash_files(spark, str(tmp_path))))  # read once, before anything changes
    headers, files, rejects = register_dataset(registered, now, F.lit("a"))
    assert headers.first().file_count == 300 and rejects.count() == 0
    (tmp_path / "d1" / "_f1.csv").write_text("changed")
    (tmp_path / "d2" / "_f2.csv").unlink()
    found, status = M.verify_datasets(headers, files, keyed(corpus.hash_files(spark, str(tmp_path)).drop("head")))
    assert sorted((r.rule, r.path) for r in found.collect()) == [("VG-DATA-001", "d1/_f1.csv"), ("VG-DATA-002", "d2/_f2.csv")]
    assert status.first().status == "FAIL"
