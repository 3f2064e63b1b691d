from __future__ import annotations

import gzip
import zlib

import numpy as np
import pytest
from corpus_cases import clashing, documents
from pyspark.sql import functions as F

from barloom.llm import html_extract, quality, queries, warc

SF = "/root/testdata/sf0.1"


def test_held_out_documents_are_told_apart(spark):
    rows = queries.op7_quality_rank(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    both = rows[rows["held_out"]].merge(labels, on="doc_id")
    good = both["quality"] == 1
    rank = both["score"].rank()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.9, auc
    assert (both["predicted"] == both["quality"]).mean() >= 0.9


def test_pairs_learn_the_direction_and_the_quantile():
    dice = np.random.default_rng(0)
    x, y = dice.standard_normal((400, quality.WIDTH)), np.arange(400) % 4 == 0
    x[y, 3] += 2.5
    model = quality.fit(x, y.astype(int))
    assert model.weights.argmax() == 3
    assert abs((model.score(x) < quality.CUT).mean() - 0.75) < 0.02


def test_the_fit_is_a_minimum_over_all_pairs():
    dice = np.random.default_rng(1)
    x, y = dice.standard_normal((60, quality.WIDTH)), np.arange(60) % 3 == 0
    model = quality.fit(x, y.astype(int))
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    d = (z[y][:, None, :] - z[~y][None, :, :]).reshape(-1, quality.WIDTH)
    slope = quality.RIDGE * model.weights - (d / (1 + np.exp(d @ model.weights))[:, None]).mean(axis=0)
    assert np.abs(slope).max() < 1e-4


def test_every_labelled_row_trains(spark):
    ids = spark.range(27_000).withColumnRenamed("id", "doc_id")
    order = ids.where(~quality.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()["doc_id"].to_numpy()
    good = set(order[20_000:].tolist())  # none of them among the rows with the smallest hashes
    assert len(good) > 1000
    rows = [(d, "Whole words stand here." if d in good else "ab $# 12 ||", int(d in good)) for d in order.tolist()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs = frame.select("doc_id", "text")
    model = quality.train(frame.select("doc_id", "quality"), docs)
    scored = quality.score_documents(docs, model).where("doc_id % 50 = 0").collect()
    assert all((r["score"] >= quality.CUT) == (r["doc_id"] in good) for r in scored)


def test_groups_on_spark_fit_as_one_in_memory(spark, monkeypatch):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(d, int(d % 7 == 0)) for d in range(60)], "doc_id long, quality int")
    used = docs.join(labels, "doc_id").where(~quality.held_out()).orderBy("doc_id").toPandas()
    want = quality.fit(np.stack([quality.features(t or "") for t in used["text"]]), used["quality"].to_numpy())
    found = quality.train(labels, docs)
    for name in ("mean", "scale", "weights", "threshold", "slope"):
        np.testing.assert_allclose(getattr(found, name), getattr(want, name), rtol=1e-3, atol=1e-5)
    monkeypatch.setattr(quality, "GROUP", 8)  # several groups: the rarer label joins each of them
    again = [quality.train(labels, rows) for rows in (docs, docs.repartition(7))]
    assert (again[0].weights == again[1].weights).all() and again[0].threshold == again[1].threshold
    assert again[0].weights @ want.weights > 0.9 * np.linalg.norm(again[0].weights) * np.linalg.norm(want.weights)


def test_scores_of_odd_texts_and_without_labels(spark):
    docs = clashing(documents(spark))
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = quality.train(none, docs)
    scored = quality.score_documents(docs, model, "_q_score")
    assert scored.columns == [*docs.columns, "_q_score"]
    assert {r["_q_score"] for r in scored.collect()} == {0.5}
    labels = spark.createDataFrame([(d, d % 2) for d in range(20)], "doc_id long, quality int")
    scored = quality.score_documents(docs, quality.train(labels, docs), "_q_score").collect()
    assert len(scored) == docs.count() and all(0 <= r["_q_score"] <= 1 for r in scored)
    assert quality.score_documents(documents(spark, []), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><article><header><h2>Head {i}</h2></header><p>First&nbsp;&amp; only
  <b>bo</b>ld {i}<p>Second<br>line {i}<script>var x = "<p>no</p>";</script></p><form><input>Send</form><div class="sitewide">Read our other articles of the week</div></article>
<div class="comments"><p>A reader says {i}</p></div><aside>More</aside><footer>All rights</footer></body></html>"""


def test_main_text_without_furniture_and_templates(spark):
    rows = [(i, f"https://one.example/{i}", PAGE.format(i=i)) for i in range(12)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://two.example/", "plain &lt;text&gt; &#233;\n x"), (23, "http://two.example/b", "<p>open <i>tags</p><p>b</i></p><!-- c"), (24, None, "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text_": F.lit(1), "marks": F.lit("x"), "share": F.lit(2)})
    found = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    for i in range(12):
        assert found[i] == f"Head {i} First & only bold {i} Second line {i}"
    assert (found[20], found[21], found[22], found[23], found[24]) == ("", "", "plain <text> é x", "open tags b", "deep")
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_not_templates(spark):
    article = "<html><body><article><h2>Only story</h2><p>The whole of it.</p><div>And its end.</div></article></body></html>"
    bare = "<html><body><h2>Bare story</h2><p>No article element.</p></body></html>"
    rows = [(i, f"http://copies.example/{i}", article) for i in range(12)] + [(100 + i, ["odd", None][i % 2], bare) for i in range(10)]
    rows += [(200 + i, f"http://mixed.example/{i}", article if i < 9 else PAGE.format(i=i)) for i in range(17)]
    rows += [(300 + i, f"http://mixed.example/{i}", bare) for i in range(3)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    assert {found[i] for i in (*range(12), *range(200, 209))} == {"Only story The whole of it. And its end."}
    assert {found[i] for i in (*range(100, 110), *range(300, 303))} == {"Bare story No article element."}


PLAIN = """<html><head><title>{head} | Site</title></head><body><div class="q7 m{i}"><ul>{menu}</ul></div><div class="wr"><div class="b2">{ad}</div>
<div class="k9"><h1>{head}</h1>{body}</div></div><div class="z">{foot}</div></body></html>"""


def plain_pages(pages: int, hosts: int, seed: int = 3):
    dice = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(map(chr, dice.integers(97, 123, 6))) for _ in range(n))
    for i in range(pages):
        menu = "".join(f"<li><a href=/{words(1)}>{words(1)}</a></li>" for _ in range(dice.integers(3, 9)))
        head, body = words(4), [words(int(dice.integers(5, 60))) for _ in range(dice.integers(1, 9))]
        html = PLAIN.format(i=i, head=head, menu=menu, ad=words(6), foot=words(5), body="".join(f"<p>{b}</p>" for b in body))
        yield (i, f"http://h{i % hosts}.example/{i}", html), " ".join([head, *body])


def test_recurrence_finds_the_article_without_any_name(spark):
    made = list(plain_pages(72, 6))
    pages = spark.createDataFrame([r for r, _ in made], "page_id long, url string, html string")
    for named in (True, False):
        found = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages, named=named).collect()}
        assert np.mean([found[r[0]] == want for r, want in made]) >= 0.9
    alone = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages.where("page_id % 6 = 0 and page_id < 36")).collect()}
    assert len(alone) == 6 and all(alone[r[0]] != want for r, want in made if r[0] in alone)  # too few pages of the host


def test_renamed_test_pages_give_the_same_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id is not null")
    host = html_extract.host_of("url")
    hosts = [r[0] for r in pages.groupBy(host.alias("h")).count().where("count >= 8").orderBy("h").limit(6).collect()]
    pages = pages.where(host.isin(hosts))
    html = F.col("html")
    for old, new in (("<article>", '<div class="k9">'), ("</article>", "</div>"), ("<nav>", '<div class="q7">'), ("</nav>", "</div>"), ("<footer>", '<div class="z">'), ("</footer>", "</div>"), ('class="ad"', 'class="b2"')):
        html = F.replace(html, F.lit(old), F.lit(new))
    want = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    found = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages.withColumn("html", html), named=False).collect()}
    assert np.mean([found[p] == want[p] for p in want]) >= 0.9


def test_templates_at_exactly_the_share_go(spark):
    page = lambda i, note: f"<html><body><div class=w>{note}<article><p>Text {i} alone.</p></article></div></body></html>"
    note = "<section>Same words everywhere</section>"
    rows = [(i, f"http://t.example/{i}", page(i, note if i < 8 else "")) for i in range(80)] * 2
    marks = html_extract.site_templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(marks) == 1 and marks[0]["_h_rows"] == 160 and 0.1 in marks[0]["_h_shares"]


def test_pages_keep_their_articles(spark):
    rows = queries.op9_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] == " ".join(r["text"].split()) for r in rows)
    assert np.mean([r["n_chars"] > 0 for r in rows]) > 0.9


def archived(spark, rows: list[tuple], folder, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("own"))
    manifest = warc.write_archive(pages, f"file://{folder}", **options)
    return manifest, {(r["page_id"], r["payload"].decode()): r for r in warc.read_archive(spark, f"file://{folder}", with_payload=True).collect()}


def test_archive_round_trip(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 5}</p>" * 50) for i in range(30)] + [(40, None, None), (41, "http://x/ y\r\nBad: z", ""), (42, "é", "ü漢" * 100), (43, "u", "\r\n\r\nWARC/1.1\r\n")]
    manifest, found = archived(spark, rows, tmp_path / "w", roll_bytes=800, task_bytes=2000)
    files = [r["name"] for r in manifest.collect()]
    assert len(files) > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows) == len(found)
    assert sorted(p.name for p in (tmp_path / "w").glob("*.warc.gz")) == sorted(files)
    for page_id, _, html in rows:
        keeper = max(p for p, _, h in rows if (h or "") == (html or ""))
        r = found[page_id, (html or "") if keeper == page_id else ""]
        data = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), warc.base32_sha1(data))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == page_id else ("revisit", keeper))


def test_archives_are_the_same_each_time(spark, tmp_path):
    rows = [(i, f"http://a.example/{i}", f"<p>{i}</p>") for i in range(20)]
    for name in ("x", "y"):
        archived(spark, rows, tmp_path / name)
    read = lambda name: {p.name: p.read_bytes() for p in (tmp_path / name).glob("*.warc.gz")}
    assert read("x") == read("y") and all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in read("x").values())


def test_small_payloads_stay_and_damage_shows(spark, tmp_path):
    _, found = archived(spark, [(1, "a", "x"), (2, "b", "x"), (None, "c", "long enough"), (3, "d", "long enough")], tmp_path / "w", min_bytes=5)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in found.values()) == [(0, "revisit"), (1, "response"), (2, "response"), (3, "response")]
    with pytest.raises(ValueError, match="digest"):
        warc.parse(warc.record(1, "u", b"body", None).replace(b"body", b"bodi"))
    manifest = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert manifest.count() == 0 and warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0


def test_archive_joins_hot_payloads_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    rows = [(i, f"u{i}", None if i % 2 else f"p{i // 4}") for i in range(40)] + [(None, None, ""), (3, "u3", None), (50, "v", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = [sorted(map(str, warc.plan_records(pages, limit=limit).collect())) for limit in (100, 0)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    keeper = {r["page_id"]: r["refers_to"] for r in warc.plan_records(pages, limit=0).collect()}
    assert keeper[1] == 39 and keeper[39] is None and keeper[None] == 39 and keeper[0] == 2 and keeper[2] is None and keeper[50] is None


def test_archive_sweeps_what_attempts_left(spark, tmp_path):
    (tmp_path / "w/_tmp").mkdir(parents=True)
    (tmp_path / "w/_tmp/pages-000000-0000.warc.gz.lost").write_bytes(b"half a rec")
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/w")
    assert not (tmp_path / "w/_tmp").exists() and warc.read_archive(spark, f"file://{tmp_path}/w").count() == 2
