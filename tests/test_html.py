from pyspark.sql import functions as F

from nameloom.functions import html
from nameloom.operators import catalogue


def pages(spark, *docs):
    return spark.createDataFrame([(i, f"http://h/{i}", d) for i, d in enumerate(docs)], "page_id long, url string, html string")


def test_table_row(spark):
    row = '<tr><td>CICC 1001</td><td>酿酒酵母</td><td>Saccharomyces cerevisiae</td><td><a href="/cicc/detail/?cid=77">查看详情</a></td></tr>'
    out = html.page_candidates(pages(spark, row)).collect()
    assert [(r["cn"], r["latin"], r["cid"]) for r in out] == [("酿酒酵母", "Saccharomyces cerevisiae", "77")]
    made = catalogue.make_candidates(html.page_candidates(pages(spark, row)).withColumns({"ord": F.lit(1), "category": F.lit("c")})).first()
    assert made["aliases"] == ["S. cerevisiae"] and made["metadata"]["detail_url"].endswith("cid=77") and made["taxon_rank"] == "species"


def test_labelled_pairs(spark):
    out = html.page_candidates(pages(spark, "<li>中文名：酿酒酵母 拉丁名：Saccharomyces cerevisiae</li><li>拉丁名: Bacillus subtilis 中文名: 枯草芽孢杆菌</li><li>产品目录 Foo bar</li>")).orderBy("row_ord").collect()
    assert [(r["cn"], r["latin"]) for r in out][0] == ("酿酒酵母", "Saccharomyces cerevisiae")
    assert all(r["latin"] != "Foo bar" for r in out)


def test_column_major_page(spark):
    items = "序号 菌株编号 菌株中文名 菌株拉丁名 具体用途 价格 操作 1 2".split() + ["CICC 1001", "CICC 1002", "酿酒酵母", "黑曲霉", "Saccharomyces cerevisiae", "Aspergillus niger"]
    out = html.page_candidates(pages(spark, "".join(f"<li>{x}</li>" for x in items), "<p>nothing</p>")).orderBy("row_ord").collect()
    assert [(r["cn"], r["latin"], r["strain"]) for r in out] == [("酿酒酵母", "Saccharomyces cerevisiae", "CICC 1001"), ("黑曲霉", "Aspergillus niger", "CICC 1002")]
    short = html.page_candidates(pages(spark, "".join(f"<li>{x}</li>" for x in items[:-1]), "<li>1</li>", "")).where("strain is not null")
    assert short.count() == 0


def test_links_and_urls(spark):
    doc = '<a>x</a><a href="/cicc/product/?mid=3&pageid=2"> A  <b>b</b></a><a href="/cicc/detail/?cid=5">查看详情</a><a href="q">open'
    found = html.links(pages(spark, doc))
    assert [(r["href"], r["text"]) for r in found.orderBy("link_ord").collect()] == [("http://h/cicc/product/?mid=3&pageid=2", "A b"), ("http://h/cicc/detail/?cid=5", "查看详情")]
    assert [r["url"] for r in html.category_urls(found, "http://h/").collect()] == ["http://h/", "http://h/cicc/product/?mid=3&pageid=2"]
    assert [tuple(r) for r in html.recommendation_urls(found).collect()] == [("http://h/cicc/detail/?cid=5", html.DEFAULT_LABEL)]
    assert html.page_url("http://h/p?a=1&pageid=9&b=", 0) == "http://h/p?a=1" and html.page_url("http://h/p?a=1", 2) == "http://h/p?a=1&pageid=2"


def test_links_of_odd_documents():
    doc = "<!-- <a href='no'>x</a> --><script>'<a href=\"no\">x</a>'</script><A HREF='a?x=1&amp;y=2' title='>'>p<i>q</i> &amp;amp; r</A><a href=b>one<a href=c>two</a> three</a><a-b href=d>x</a><a name=z>t</a><a href=''>e</a><a href='f'>open"
    assert html.links_of(doc, "http://h/k/") == [("http://h/k/a?x=1&y=2", "pq & r"), ("http://h/k/c", "two")]
    assert html.links_of(None, None) == [] and html.page_url("http://h/p?b=2&a=1&b=3#x", 4) == "http://h/p?b=2&b=3&a=1&pageid=4#x"


def test_crawl_of_categories_and_of_recommendations(spark):
    row = lambda cn, latin, cid: f"<tr><td>{cn}</td><td>{latin}</td><td><a href='/cicc/detail/?cid={cid}'>x</a></td></tr>"
    start, cat = "http://h/cicc/product/?mid=3", "http://h/cicc/product/?mid=3&c=7"
    table = [(start, "<a href='?mid=3&c=7'>more</a><tr><td>酿酒酵母</td><td>Saccharomyces cerevisiae</td></tr>"), (cat, row("黑曲霉", "Aspergillus niger", 2)), (cat + "&pageid=1", ""), (cat + "&pageid=2", row("枯草菌", "Bacillus subtilis", 3) + row("重复", "ASPERGILLUS niger", 9)), (cat + "&pageid=5", row("太远菌", "Toofar away", 4))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(table)], "page_id long, url string, html string")
    out = catalogue.crawl(df, start, 9).orderBy("ord").collect()
    assert [(r["entity_id"], r["scientific_name"]) for r in out] == [("CICC_TAXON:00001", "Saccharomyces cerevisiae"), ("CICC_TAXON:00002", "Aspergillus niger"), ("CICC_TAXON:00003", "Bacillus subtilis")]
    assert out[0]["metadata"]["detail_url"] is None and out[1]["metadata"]["detail_url"].endswith("cid=2") and out[0]["metadata"]["source_page"] == start
    listed = [("http://h/s", "<a href='/cicc/detail/?cid=1'>甲查看详情</a><a href='/cicc/detail/?cid=2'>查看详情</a>"), ("http://h/cicc/detail/?cid=1", row("黑曲霉", "Aspergillus niger", 2)), ("http://h/cicc/detail/?cid=2", row("黑曲霉", "Aspergillus niger", 2))]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(listed)], "page_id long, url string, html string")
    (only,) = catalogue.crawl(df, "http://h/s").collect()
    assert only["metadata"]["category"] == "甲" and [tuple(e) for e in only["metadata"]["source_examples"]] == [("CICC", html.DEFAULT_LABEL, "http://h/cicc/detail/?cid=2")]


def test_stop_rule(spark):
    counts = spark.createDataFrame([("c", i, n) for i, n in enumerate([3, 0, 2, 0, 0, 5])], "category string, page_no long, n long")
    assert sorted(r["page_no"] for r in catalogue.pages_before_stop(counts).collect()) == [0, 1, 2, 3, 4]


def test_merge(spark):
    base = spark.createDataFrame([(0, "TAXON:0001", "Staphylococcus aureus"), (1, "TAXON:0007", "Escherichia coli"), (2, "X9", "Foo bar")], "ord long, entity_id string, scientific_name string")
    new = spark.createDataFrame([(i, None, s) for i, s in enumerate(["ESCHERICHIA COLI", "Bacillus subtilis", "bacillus subtilis", "Bacillus cereus"])], "ord long, entity_id string, scientific_name string")
    out = catalogue.merge(base, new).where("is_new").orderBy("ord").collect()
    assert [(r["entity_id"], r["scientific_name"]) for r in out] == [("TAXON:0008", "Bacillus subtilis"), ("TAXON:0009", "Bacillus cereus")]


def test_keys_are_case_folded_in_any_script(spark):
    base = spark.createDataFrame([(0, "TAXON:0001", "Straße x")], "ord long, entity_id string, scientific_name string")
    new = spark.createDataFrame([(i, None, s) for i, s in enumerate(["STRASSE x", "ΣΑΣ y", "σας Y"])], "ord long, entity_id string, scientific_name string")
    assert [r["scientific_name"] for r in catalogue.merge(base, new).where("is_new").collect()] == ["ΣΑΣ y"]


def test_source_examples_skip_the_first_sighting(spark):
    rows = [(0, "Aa x", "c0", "u0"), (1, "aa X", "c1", "u0"), (2, "Aa x", "c2", "u1"), (3, "Aa x", "c3", "u1"), (4, "Bb y", "c", "u")]
    out = catalogue.source_examples(spark.createDataFrame(rows, "ord long, scientific_name string, category string, url string")).collect()
    assert [(r["k"], [tuple(e) for e in r["examples"]]) for r in out] == [("aa x", [("CICC", "c1", "u0"), ("CICC", "c2", "u1")])]
