"""The stages against brute force on the smallest tables, and what the package promises about its place."""

import ast
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as pipeline
from daypanel.llm.words import words

ROOT, SF_DIR = Path(pipeline.__file__).parent, "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@needs_tables
def test_stages(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({tuple(r) for r in docs.collect()} if name != "bpe" else docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    source = {tuple(r) for r in duckdb.sql(f"SELECT * FROM '{SF_DIR}/documents.parquet'").fetchall()}
    toxic_of = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_DIR}/labels.parquet'").fetchall())
    clean, exact, near, safe, tokens = kept

    assert clean <= source and all(r in clean for r in source if toxic_of.get(r[0]) == 0)
    assert sum(toxic_of.get(r[0]) == 1 for r in clean) <= sum(v == 1 for v in toxic_of.values()) // 3

    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for r in sorted(clean):
        last[fold(r[1])] = r
    assert exact == set(last.values())

    rows = sorted(exact)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r[1] or "")) else set() for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    assert near == {min(rows[i] for i in range(len(rows)) if group[i] == g) for g in set(group)}

    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_DIR}/benchmark.parquet'").fetchall()]
    assert safe <= near and not any(t in r[1] for r in safe for t in items)
    assert all(any(len(set(words(t)) & set(words(r[1]))) >= len(set(words(t))) // 2 for t in items) for r in near - safe)

    library = tokenizers.Tokenizer.from_file(pipeline.vocabulary_path())
    text_of = {r[0]: r[1] for r in safe}
    assert {r.doc_id: r.ids for r in tokens} == {d: library.encode(t or "", add_special_tokens=False).ids for d, t in text_of.items()}


def test_nothing_else_imports_the_package():
    for file in (ROOT / "daypanel").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            names = [getattr(n, "module", None) or n.names[0].name for n in ast.walk(ast.parse(file.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom))]
            assert not any("llm" in name for name in names), file
