from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm.boosting import BoostedTrees
from logweir.llm.common import hash_sample
from logweir.llm.extraction import decode, extract, features, fit, main_text, parse, rewritten, weak_labels
from cases import words


def page(k: int) -> tuple[str, str]:
    """Markup and its main text."""
    title = " ".join(words(k, 6))
    paragraphs = [" ".join(words(1000 * k + i, 5 + 7 * ((k + i) % 6))) + "." for i in range(1 + k % 5)]
    body = "".join(f"<p>{p} &amp; co" + ("" if i % 3 else "</p>") for i, p in enumerate(paragraphs))
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in words(k + 7, 5))
    markup = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav>"
        f"<!-- ad --><div class=\"ad\">{' '.join(words(k + 9, 6))}</div><article><h1>{title}</h1>{body}</article><footer>&copy; {' '.join(words(k + 3, 4))}</footer>"
    )
    return markup, "\n".join([title, *(f"{p} & co" for p in paragraphs)])


@pytest.fixture(scope="module")
def model():
    return fit([page(k)[0] for k in range(60)])


def test_held_out_pages(model):
    asked = [page(k) for k in range(500, 620)]
    got = main_text(model, [m for m, _ in asked])
    assert sum(g == t for g, (_, t) in zip(got, asked)) >= 117


def test_other_surroundings(model):
    right = total = 0
    for k in range(700, 725):
        for version in rewritten(page(k)[0], [" ".join(words(k + j, 9)) for j in range(9)]):
            nodes, blocks = parse(version)
            main = weak_labels(nodes)
            right += main_text(model, [version])[0] == "\n".join(t for i, t in blocks if main[i])
            total += 1
    assert right >= 0.95 * total


def test_blocks_and_references(model):
    nodes, blocks = parse("<body>a <b>b</b>\n c<p>x&nbsp;&eacute;&#233; y<p>z<script>no</script><br>q<ul><li>1<li>2</ul><!-- n --><textarea>t</textarea>end")
    assert [t for _, t in blocks] == ["a b c", "x éé y", "z q", "1", "2", "end"]
    assert main_text(model, [None, "", "<p>", "<script>x"]) == ["", "", "", ""]
    assert parse("<div><span><p>in</span> out</p>")[1]
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert [t for _, t in parse(deep)[1]] == ["x"]
    assert len(main_text(model, [deep])) == 1


def test_decoding_is_the_best_consistent_choice():
    r = np.random.default_rng(4)
    for _ in range(40):
        nodes, _ = parse("<div>" + "".join(r.choice(["<div>x", "</div>", "<p>y</p>"], 6)))
        margin = r.normal(size=len(nodes)) * 2
        kept = decode(nodes, margin)
        like = lambda k: sum(-np.log1p(np.exp(-m if x else m)) for m, x in zip(margin, k))
        fits = lambda k: k[0] and all(not k[i] or k[nodes[i].up] for i in range(1, len(nodes)))
        best = max((like(k) for n in range(1 << len(nodes)) if fits(k := [n >> i & 1 for i in range(len(nodes))])))
        assert fits(kept) and abs(like(kept) - best) < 1e-9


def test_trees_learn(model):
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = BoostedTrees(trees=30).fit(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    assert features(*parse("<p>x</p>")).shape[0] == 2


def test_query_form(spark):
    rows = [(k, f"u{k}", page(k)[0], "old", "e") for k in range(30)] + [(100, None, None, "old", None), (101, "v", "", None, "e"), (3, "u3", page(3)[0], "old", "e")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, extra string")
    out = extract(pages)
    assert sorted(out.columns) == ["extra", "n_chars", "page_id", "text", "url"]
    got = out.collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r for r in got}
    assert texts[100]["text"] == texts[101]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(texts[k]["text"] == page(k)[1] for k in range(30)) >= 28
    assert extract(pages.where("page_id < 0")).collect() == []


def test_pages_that_repeat_leave_a_sample(spark):
    rows = [(k, f"u{k}", page(k)[0]) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    many = pages.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    held = hash_sample(many.select("html"), F.col("html"), 150).collect()
    assert sorted(r["html"] for r in held) == sorted(r[2] for r in rows)
    texts = lambda df: {(r["page_id"], r["text"]) for r in df.select("page_id", "text").collect()}
    assert texts(extract(many.where("n <= 20"), training=many)) == texts(extract(pages))


def test_a_sample_holds_each_key_once(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), (F.col("id") % 3).alias("x"))
    held = hash_sample(rows, F.col("k"), 500).collect()
    again = hash_sample(rows.repartition(13), F.col("k"), 500).collect()
    assert len(held) == len({r["k"] for r in held}) == 500 and held == again
    assert hash_sample(rows.where("k < 0"), F.col("k"), 500).collect() == []
