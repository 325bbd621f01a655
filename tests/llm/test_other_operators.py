import random

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from ratiosift.llm import html_layouts, html_text, queries
from ratiosift.llm.near_dedup import near_duplicates
from ratiosift.llm.decontaminate import decontaminate
from ratiosift.llm.quality import quality
from ratiosift.llm.quotations import link
from ratiosift.llm.toxicity import toxicity


def test_quotations(spark):
    rows = [(1, 0, "u", "Hello there.\nHow are you?\n\nSecond para here"), (1, 1, "a", "> Hello there. How\n> are you?\nI am fine"), (1, 2, "u", ">> Hello there. How are you?\n> I am fine\nGood."), (1, 3, "b", "> Second para here\nok"), (1, 4, "c", "new topic"), (1, 5, "c", "> new topic\nre"), (2, 0, "u", "> nothing\nx"), (None, 0, "u", "> x"), (2, 1, None, None), (1, 2, "u", ">> Hello there. How are you?\n> I am fine\nGood.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as thread", "2 as position")
    out = sorted((r.conv_id or 0, r.position, r.turn, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.text) for r in link(spark, df).collect())
    assert out == [
        (0, 0, 0, 1, 0, None, 0, ""),
        (1, 0, 0, 0, 0, None, 0, "Hello there.\nHow are you?\n\nSecond para here"),
        (1, 1, 1, 1, 1, 0, 0, "I am fine"),
        (1, 2, 2, 2, 2, 1, 0, "Good."),
        (1, 3, 2, 2, 2, 1, 0, "Good."),
        (1, 4, 3, 1, 1, 0, 0, "ok"),
        (1, 5, 4, 0, 0, None, 4, "new topic"),
        (1, 6, 5, 1, 1, 4, 4, "re"),
        (2, 0, 0, 1, 0, None, 0, "x"),
        (2, 1, 1, 0, 0, None, 1, ""),
    ]
    assert link(spark, df.limit(0)).count() == 0


def test_quotations_by_the_sql(spark):
    """Planted quotations of several levels, long messages, ties and repeated rows, against the registered SQL."""
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "Omega!", "x1", "é"])
    rows = []
    for conv in range(30):
        said = []
        for turn in range(r.randint(1, 9)):
            lines = []
            for _ in range(r.randint(0, 3)):
                if said and r.random() < 0.7:
                    quoted = r.choice(said).splitlines() or [""]
                    lines += [">" * r.randint(1, 3) + r.choice([" ", ""]) + x for x in quoted[: r.randint(1, 4)]]
                lines += [" ".join(word() for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 3))] + [""] * r.randint(0, 1)
            text = "\n".join(lines).strip()
            said.append(text)
            rows += [(conv, turn, r.choice(["u", "a", None]), r.choice([text, text, text, None]))] * r.choice([1, 1, 1, 2])
    rows.append((99, 0, "u", "\n".join(f"line {k} of a long message" for k in range(3000))))
    rows.append((99, 1, "a", "\n".join(f"> line {k} of a long message" for k in range(3000)) + "\nyes"))
    got = link(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    con.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given")
    want = con.sql(queries.ORACLE_SQL["op9_quotation_linking"]).df()
    columns = sorted(c for c in want.columns if c != "position")  # repeated rows take places at will
    plain = lambda df: sorted((tuple(None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in row) for row in df[columns].itertuples(index=False)), key=str)
    assert [tuple(map(str, x)) for x in plain(got)] == [tuple(map(str, x)) for x in plain(want)]
    assert (got.n_linked > 0).sum() > 30 and got.n_linked[got.conv_id == 99].max() == 1


@pytest.fixture(scope="module")
def trees():
    return html_text.train(400)


def test_html_on_unseen_layouts(trees):
    pages = html_layouts.pages(150, seed=77)
    got = html_text.main_text([p.replace(html_layouts.MARK, "") for p in pages], trees)
    tp = fp = fn = 0
    for p, text in zip(pages, got, strict=True):
        want = {t.replace(html_layouts.MARK, "") for _, t, _ in html_text.parse(p)[1] if t[0] == html_layouts.MARK}
        own = set(text.split("\n\n")) - {""}
        tp, fp, fn = tp + len(want & own), fp + len(own - want), fn + len(want - own)
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.9


def test_html_reader_and_decoding(trees):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><article><h1>Tom &amp; Jerry</h1><p><b>First  part.<br>Second &lt;part&gt; of it, with words.<p>Next paragraph here, long enough to be read. It has two sentences.</p></article><footer>&copy; me"
    assert html_text.main_text([page], trees) == ["Tom & Jerry\n\nFirst part. Second <part> of it, with words.\n\nNext paragraph here, long enough to be read. It has two sentences."]
    odd = page.replace("Next paragraph here", "The area <math><mi>r</mi></math> is <svg><text>small</text></svg> <noscript>indeed</noscript>, <object>spare words</object> here")
    assert html_text.main_text([odd], trees)[0].endswith("The area r is small indeed, spare words here, long enough to be read. It has two sentences.")
    assert html_text.main_text(["", "   ", "<p", "<!-- x"], trees)[:2] == ["", ""]
    keep = html_text.decode([0.1, 3.0, -6.0, 4.0, -5.0], [-1, 0, 1, 1, 0], [True] * 5)
    assert keep[3] and not keep[2] and not keep[4]


def test_html_query_shape(spark, sf_dir):
    from ratiosift.llm.html_text import extract

    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", "<p>x</p>"), (2, "v", "<p>x</p>")], "page_id long, url string, html string").selectExpr("*", "1 as text")
    out = extract(spark, df).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert extract(spark, df.limit(0)).count() == 0


def test_pipeline_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    left = docs.toPandas()
    assert left.doc_id.is_unique
    step = lambda ids: docs.where(docs.doc_id.isin([int(i) for i in ids]))
    ids = set(left.doc_id)
    for run, good in ((lambda d: toxicity(spark, d, labels), lambda r: r.score < 0.3), (lambda d: quality(spark, d, labels), lambda r: r.score >= 0.3), (lambda d: near_duplicates(spark, d), lambda r: r.kept), (lambda d: decontaminate(spark, d, bench), lambda r: not r.contaminated)):
        ids = {r.doc_id for r in run(step(ids)).collect() if good(r)}
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(out.doc_id) == ids and not out.duplicated(["doc_id", "piece"]).any()
    assert len(corpus_pipeline.STAGES) == 5


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
