"""The pipeline against a brute-force version, stage by stage, and the entry's guard."""

import subprocess
import sys
from pathlib import Path

import test_packing
import test_quality_left_out
import test_simhash_dedup
import test_substring_dedup

import __spark_entry__
import corpus_pipeline as C
from wingspan.llm import language_id
from wingspan.llm.common import table

SF = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    rows, out = {r.doc_id: tuple(r) for r in docs.collect()}, {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out[name] = docs
        if name == "quality_rules":
            judged = test_quality_left_out.brute([(d, r[1]) for d, r in rows.items()], good, 32_768, 1.0, 0.005)
            rows = {d: rows[d] for d in (j[0] for j in judged if j[-1])}
        elif name == "language_id":
            model = language_id.fit(before.filter(~language_id.held_out()))
            rows = {d: r for d, r in rows.items() if (p := model.predict(r[1]))[0] != "und" and p[1] >= 0.4}
        elif name == "simhash_dedup":
            low = test_simhash_dedup.brute_components([test_simhash_dedup.brute_fingerprint(r[1]) for r in rows.values()], list(rows))
            rows = {d: r for (d, r), c in zip(rows.items(), low, strict=True) if d == c}
        elif name == "substring_dedup":
            texts = test_substring_dedup.brute_runs([(d, r[1]) for d, r in rows.items()], 2, 30)
            rows = {d: (d, texts[d], r[2], r[3], len(texts[d])) for d, r in rows.items()}
        if name != "packing":
            assert docs.columns == C.COLUMNS
            assert as_rows(docs) == sorted(rows.values(), key=str)
    test_packing.check(docs.collect(), [(d, r[1]) for d, r in rows.items()])
    assert len(rows) < table(spark, SF, "documents").count()
    assert as_rows(C.run(spark, SF).groupBy("doc_id").sum("length")) == as_rows(docs.groupBy("doc_id").sum("length"))


def test_odd_rows(spark):
    same = "the quick thing went over there and on and on with all of its other things in the end of that long day"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, same, "en", "s", 1), (3, same, "en", "s", 1), (None, same, None, "s", 1),
            (4, same + "\nmore lines of five words", "en", None, None), (5, same.upper() + " x", "de", "s", 9)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, row string")
    left = {}
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == C.COLUMNS
        left[name] = sorted((r.doc_id for r in out.collect()), key=str)
    assert left["language_id"] == [3, 3, 4, 5, None]
    assert left["simhash_dedup"] == [1, 3, 4, 5]  # the empty ones, the three alike, and the two that differ
    assert left["substring_dedup"] == [1, 2, 3, 3, 4, 5, None]
    assert set(left["packing"]) == {1, 2, 3, 4, 5, None}  # a row for each piece


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_entry_without_llm(tmp_path):
    """Without the two folders and the pipeline, the rest imports and lists its queries."""
    root = Path(__file__).resolve().parents[2]
    for p in root.iterdir():
        if p.name in ("__spark_entry__.py",):
            (tmp_path / p.name).write_text(p.read_text())
    (tmp_path / "wingspan").mkdir()
    for p in (root / "wingspan").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "wingspan" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
