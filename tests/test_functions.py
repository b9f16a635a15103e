"""Functions and operators on small cases, with the edges that decide their meaning."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folio.functions import cells, text
from folio.operators import answer, blocks, chunking, enrich, pages, quality, records, search
from folio.sources import store
from folio.streaming import daily


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("cell, value", [("R$ 1.234,56", "1234.56"), ("1234.56", "1234.56"), ("-5,0", "5"), ("001/2025", "1"), ("1.234", "1.234"), ("abc", None), ("", None), ("1.2.3", None)])
def test_number(spark, cell, value):
    got = one(spark, cell, cells.number)
    assert got == (None if value is None else Decimal(value))


def test_brl_is_half_even(spark):
    for x, y in (("1234.565", "1.234,56"), ("0.125", "0,12"), ("1000000", "1.000.000,00")):
        assert one(spark, Decimal(x), cells.brl, "decimal(20,6)") == y


ROWS = [["1", "Alfa", "150.000,00", "Vigente"], ["2", "Beta", "R$ 250.000,00", "vigente"], ["3", "Gama", "100.000,00", "Encerrado"], ["4", "Delta"], [" total ", "", "500.000,00", ""]]


@pytest.fixture(scope="module")
def contracts(spark):
    return spark.createDataFrame([(["Número", "Fornecedor", "Valor", "Status"], ROWS), (["A", "B", "C", "D"], [])], "headers array<string>, rows array<array<string>>").select(
        "rows", "headers", cells.column_index(F.col("headers"), "valor").alias("v"), cells.column_index(F.col("headers"), "status").alias("s")
    )


def test_table_tools(contracts):
    r, v, s = F.col("rows"), F.col("v"), F.col("s")
    got = contracts.select(
        cells.count_rows(r).alias("n"),
        cells.count_rows(r, s, "Vigente").alias("active"),
        cells.sum_column(r, v).alias("sum"),
        F.transform(cells.filter_rows(r, v, "gt", "120000"), lambda x: x[0]).alias("big"),
        F.transform(cells.filter_rows(r, s, "contains", "ENC"), lambda x: x[0]).alias("ended"),
        F.transform(cells.sort_rows(r, v, True), lambda x: F.trim(x[0])).alias("down"),
        cells.extract_value(r, F.lit(1), "bet", v).alias("cell"),
        cells.total_row(F.col("headers"), r).alias("total"),
    ).collect()
    a, b = got
    assert (a["n"], a["active"], a["sum"]) == (4, 2, Decimal(500000))
    assert a["big"] == ["1", "2", " total "] and a["ended"] == ["3"]
    assert a["down"][1:] == ["total", "2", "1", "3"] and a["down"][0] == "4"  # what isn't a number stands first
    assert a["cell"] == "R$ 250.000,00" and a["total"] == ["TOTAL", "", "R$ 500.000,00", ""]
    assert (b["n"], b["sum"], b["cell"]) == (0, Decimal(0), None)


def test_table_verdicts(spark):
    cases = [
        (["A"], [["1"]], "single_column"),
        (["a;b", "c"], [["1", "2"]], "raw_separators_in_headers"),
        (["A", "B"], [["", " "]], "all_rows_empty"),
        (["A", "B"], [[";;;", "x"]], "corrupted_cells"),
        (["A", "B"], [["1", "2"]] * 4, "all_rows_identical"),
        (["A", "B"], [["1", "2"]] * 3, "ok"),
    ]
    df = spark.createDataFrame(cases, "headers array<string>, rows array<array<string>>, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", cells.verdict(F.col("headers"), F.col("rows")).alias("got")).collect())


def test_queries(spark):
    assert one(spark, "Quais são as diárias?", text.clean_query) == "diárias" == text.clean("Quais são as diárias?")
    assert one(spark, "São de o?", text.clean_query) == ""
    assert one(spark, "gastos x", text.expand_query) == "gastos x despesas valores pagos custos"
    assert one(spark, "nada", text.expand_query) is None
    assert one(spark, "baixar isso", text.intent) == "followup" and one(spark, "como chego", text.intent) == "general_search" and one(spark, "menu pdf", text.intent) == "document_query"
    assert one(spark, "DIÁRIAS lições", text.lexemes) == ["diarias", "licoes"]


def test_summary_and_section(spark):
    assert one(spark, "a" * 600, text.summary) == "a" * 500 + "..."
    assert one(spark, "ab " * 200, text.summary) == ("ab " * 166 + "ab")[: len("ab " * 166) - 1] + "..."
    body = "intro\nAta 3/2024 of things\n2023\nmore"
    assert one(spark, body, lambda c: text.relevant_section(c, "ata de 2024")).startswith("Ata 3/2024")
    assert one(spark, body, lambda c: text.relevant_section(c, "ano 2023")).startswith("2023")
    assert one(spark, body, lambda c: text.relevant_section(c, "things")).startswith("things")


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (384, [384]), (385, [384, 39]), (730, [384, 384]), (731, [384, 384, 39])])
def test_fixed_windows(spark, n, sizes):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(n)))], "id int, t string")
    got = chunking.chunked(df, "id", "t").orderBy("chunk_index").collect()
    assert [len(r["chunk_text"].split()) for r in got] == sizes
    assert [r["chunk_index"] for r in got] == list(range(len(sizes)))
    assert {w for r in got for w in r["chunk_text"].split()} == {f"w{k}" for k in range(n)}


def test_quality_of_edges(spark):
    good = "This sentence holds several plain words. " * 1 + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} plain." for k in range(60))
    df = spark.createDataFrame([(1, ""), (2, None), (3, good), (4, ("the same line again and again\n" * 30))], "id int, t string")
    got = {r["id"]: r for r in quality.scored(df, "t").collect()}
    assert got[1]["flags"] == got[2]["flags"] == ["too_short", "low_density", "incoherent", "low_information"]
    assert got[1]["score"] == pytest.approx(0.2 + 0.1) and got[1]["quarantined"]
    assert not got[3]["quarantined"] and "internal_dup" in got[4]["flags"]
    twice = quality.duplicates(spark.createDataFrame([(3, "A  b"), (1, "a B"), (2, "c")], "id int, t string"), ["id"], "t").collect()
    assert [(r["id"], r["first_id"]) for r in twice] == [(3, 1)]


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 5, 0), (1, 5, 0), (0, 6, 1), (1, 7, 10)], "list int, id int, pos int")
    got = {r["id"]: r["score"] for r in search.fuse(lists).collect()}
    assert got[5] == pytest.approx(2 / 61) and got[6] == pytest.approx(1 / 62) and got[7] == pytest.approx(1 / 71)


def test_search_needs_every_lexeme(spark):
    df = spark.createDataFrame([(1, "diária paga", "x"), (2, "x", "DIARIA e viagem"), (3, "viagem", "y")], "id int, title string, body string")
    hits = search.matching(df, "Quais diárias?", {"title": 1.0, "body": 0.2})
    assert hits.count() == 0
    hits = search.matching(df, "diaria viagem", {"title": 1.0, "body": 0.2}).collect()
    assert [r["id"] for r in hits] == [2]
    assert search.matching(df, "de o", {"title": 1.0}).count() == 0


def test_entities(spark):
    df = spark.createDataFrame([(1, "Em 01/02/2024 o Contrato nº 12/2024 e o contrato nº 12/2024; R$ 1.234,56. Pregão Eletrônico nº 5/2023, CNPJ 12.345.678/0001-90, processo 0001234-56.2024.6.18.0000")], "id int, t string")
    got = sorted((r["entity_type"], r["entity_value"]) for r in enrich.entities(df, "id", "t").collect())
    assert got == [("contract_number", "Contrato nº 12/2024"), ("cpf_cnpj", "12.345.678/0001-90"), ("date_range", "01/02/2024"), ("monetary_value", "R$ 1.234,56"), ("pregao", "Pregão Eletrônico nº 5/2023"), ("process_number", "0001234-56.2024.6.18.0000")]
    pairs = [(1, "pregao", "p"), (2, "pregao", "p"), (9, "pregao", "p"), (3, "contract_number", "c"), (1, "contract_number", "c"), (5, "pregao", "q")]
    rows = spark.createDataFrame(pairs, "id long, entity_type string, entity_value string")
    edges = lambda df: sorted((r["source_id"], r["target_id"], r["relation_type"]) for r in df.collect())
    assert edges(enrich.entity_relations(rows)) == [(2, 1, "origina"), (3, 1, "referencia"), (9, 1, "origina")]
    assert edges(enrich.relations_of(rows, 2)) == [(1, 2, "origina"), (2, 1, "origina"), (2, 9, "origina"), (9, 2, "origina")]
    assert sorted(map(tuple, enrich.relation_counts(rows).collect())) == [("origina", 6), ("referencia", 2)]
    assert sorted(map(tuple, enrich.peers(rows).filter("entity_value = 'p'").collect())) == [(1, "pregao", "p", 2, 2), (2, "pregao", "p", 2, 1), (9, "pregao", "p", 2, 1)]


def test_html(spark):
    html = "<title>T — site</title><nav>menu</nav><h1>Head</h1><p>One <b>two</b><script>x()</script></p><a href='/a'>link</a><table><tr><td>c</td></tr></table>"
    got = one(spark, html, pages.extract)
    assert got["title"] == "T" and got["headings"] == ["Head"] and got["links"] == ["/a"]
    assert got["text"] == "Head\nOne two\nlink\nc"
    assert one(spark, None, pages.extract)["text"] == ""
    assert one(spark, "HTTP://a/b/?x=1#y", pages.normal_url) == "HTTP://a/b"
    assert one(spark, "http://a/b.PDF?x", pages.content_kind) == "pdf"


def test_block_rules():
    for line in ("Receitas e despesas", "RECEITAS 2024", "2024 em números", "Órgãos"):
        assert blocks.is_heading(line)
    for line in ("Total:", "1. Objeto", "fim", "Uma frase.", "Duas\nLinhas", "A " * 13, "A" * 81, "", "Quem? Eu"):
        assert not blocks.is_heading(line)
    assert blocks.is_table("a | b\nd | e") and blocks.is_table("x\na|b\nc|d") and not blocks.is_table("a | b | c") and not blocks.is_table("a|b\nc|d\nx\ny")


def chunks_of(text, breadcrumb=None, **limits):
    return blocks.chunks(blocks.text_blocks(text, breadcrumb), **limits)


def test_text_chunks():
    paragraph = "Palavra comum aqui. " * 50  # 195 tokens
    body = f"Receitas\n\n{paragraph}\n\nDespesas\n\n{paragraph}\n\na | b\nc | d\n\nfim"
    got = chunks_of(body, "Portal")
    assert [(c[0], c[1], c[3], c[4]) for c in got] == [(0, "Portal > Despesas", 399, True)]  # the table and the end are small: they join
    alone = chunks_of(body, least=0)
    assert [(c[1], c[4]) for c in alone] == [("Despesas", False), ("Despesas", True), ("Despesas", False)] and alone[1][2] == "a | b\nc | d"
    many = chunks_of("\n\n".join(["Um texto de teste com oito palavras iguais. " * 30] * 5))
    assert [c[3] for c in many] == [624, 624, 312]
    long = "Uma frase curta. " * 400
    assert [c[3] for c in chunks_of(long, least=0)] == [3] * 400 and all(c[3] <= 800 for c in chunks_of(long))
    word = " ".join(f"w{k}" for k in range(1000))
    assert [c[3] for c in chunks_of(word)] == [650, 650]
    table = "\n".join(f"linha {k} | valor" for k in range(400))
    assert all(c[4] and c[3] <= 800 for c in chunks_of(table)) and "\n".join(c[2] for c in chunks_of(table)) == table
    assert chunks_of("") == chunks_of(None) == chunks_of(" \n ") == []


def test_html_chunks():
    items = "".join(f"<li>item {k}</li>" for k in range(3))
    many = "".join(f"<li>item número {k} da lista</li>" for k in range(60))
    rows = "".join(f"<tr><th>{k}</th><td>v <b>x</b></td></tr>" for k in range(60))
    html = f"<html><head><title>t</title></head><body><nav><p>um menu que não conta aqui</p></nav><h1>Um</h1><div><p>curto</p><p>Um parágrafo <b>com</b> mais de vinte</p></div><h3>Fundo</h3><ul>{items}</ul><h2>Dois</h2><table>{rows}</table><ol>{many}</ol><script>x()</script><blockquote><p>fora das regras, mesmo longo</p></blockquote></body></html>"
    got = list(blocks.html_blocks(html, "Portal"))
    assert got[0] == ("Um parágrafo com mais de vinte", "Portal > Um", False)
    assert got[1] == ("• item 0\n• item 1\n• item 2", "Portal > Fundo", False)
    assert got[2].table and got[2].section == "Portal > Dois" and got[2].text.split("\n")[::50] == ["0 | v x", blocks.TABLE_CUT]
    assert [b.text for b in got[3:]] == [f"• item número {k} da lista" for k in range(60)]
    assert list(blocks.html_blocks(None)) == []
    for bare in ("<p>sem corpo, mas um texto longo</p>", "<div><p>sem corpo, mas um texto longo</p></div>", "<html><head><title>x</title></head><div><p>sem corpo, mas um texto longo</p>"):
        assert [b.text for b in blocks.html_blocks(bare)] == ["sem corpo, mas um texto longo"]
    assert list(blocks.html_blocks("<body>" + "<div>" * 5000 + "<p>um texto fundo na árvore</p>"))[0].text == "um texto fundo na árvore"


def test_chunks_of_tables_and_columns(spark):
    df = spark.createDataFrame([(1, "Título\n\n" + "uma palavra " * 90, "a > b"), (2, None, None)], "id long, body string, trail string")
    got = blocks.semantic_chunks(df, "id", "body", breadcrumb="trail").collect()
    assert [(r["id"], r["section_title"]) for r in got] == [(1, "a > b > Título")]


def test_total_rows(spark):
    cases = [
        (["item", "valor"], [["a", "10,00"], ["TOTAL", "99"]], ["TOTAL", "R$ 10,00"]),
        (["valor", "item"], [["10,00", "a"], ["1,50", "b"]], ["R$ 11,50", ""]),
        (["item", "valor", "custo"], [["a", "x", "3"]], ["TOTAL", "", "R$ 3,00"]),
        (["item", "nota"], [["a", "1"]], None),
        (["item", "valor"], [["a", "x"]], None),
        (["item", "valor"], [], None),
    ]
    df = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(cases)], "i int, h array<string>, r array<array<string>>")
    got = {r["i"]: r["t"] for r in df.select("i", cells.total_row(F.col("h"), F.col("r")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_repeated_lines_of_any_ending(spark):
    line = "uma linha de mais de vinte letras"
    for end in ("\n", "\r\n", "\r", "\u2028", "\x0b"):
        assert one(spark, f"{line}{end}{line}{end}fim", quality.measured)["repeated"]
    assert not one(spark, f"{line}\nx\n{line}", quality.measured)["repeated"]


def test_records(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 0), (3, "c", 0)], "k int, v string, n int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(records.upsert(old, new, ["k"])) == [(1, "a", 0), (2, "B", 0), (3, "c", 0)]
    assert rows(records.insert_missing(old, new, ["k"])) == [(1, "a", 0), (2, "b", 0), (3, "c", 0)]
    assert rows(records.merge(old, new, ["k"], {"n": F.col("stored.n") + 1})) == [(1, "a", 0), (2, "b", 1), (3, "c", 0)]
    assert rows(records.delete(old, new, ["k"])) == [(1, "a", 0)]


def test_store(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert store.rewrite(spark.range(5), path) == 0
    before = store.current(spark, path)
    assert store.rewrite(before.filter("id > 1"), path) == 1
    assert before.count() == 5  # a reader of the version before goes on
    (tmp_path / "t/version=2").mkdir()  # an unfinished write
    assert store.versions(spark, path) == [0, 1] and store.rewrite(store.current(spark, path).filter("id > 2"), path) == 2
    assert sorted(r[0] for r in store.current(spark, path).collect()) == [3, 4] and store.versions(spark, path) == [1, 2]
    (tmp_path / "f.csv").write_bytes("Número;Valor\n1;2,5\n3;4\n".encode("latin-1"))
    got = store.delimited(spark, f"{tmp_path}/f.csv")
    assert got.columns == ["Número", "Valor"] and got.count() == 2
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a/x/1</loc><lastmod>2024</lastmod></url><url><loc>http://b/2</loc></url></urlset>")
    assert [tuple(r) for r in store.sitemap(spark, f"{tmp_path}/s.xml", "http://a/").collect()] == [("http://a/x/1", "2024")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    got = store.crawl_order(edges, spark.createDataFrame([("a",)], "url string"), 3)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_dt_interval(0, 0, id * 7) AS ts, id % 3 AS user_id, 'view' AS event_type, 1.0D AS value FROM range(300)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    stream = daily.event_stream(spark, str(tmp_path))
    query = daily.daily(stream).writeStream.format("memory").queryName("by_day").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("by_day").collect()) == 300
    for _ in range(2):  # a second run finds nothing new
        daily.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["ts", "user_id"]).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_hybrid_without_vectors_and_widened(spark):
    hits = spark.createDataFrame([(5, 0), (6, 1)], "id int, pos int")
    near = spark.createDataFrame([(6, 0), (7, 1)], "id int, pos int")
    assert [r["id"] for r in search.hybrid([hits], [], 10).collect()] == [5, 6]
    both = search.hybrid([hits], [near], 10)
    assert [r["id"] for r in both.collect()] == [6, 5, 7]
    assert search.widened(both, lambda: 1 / 0, 10) is both
    wide = search.widened(search.hybrid([hits], [], 10), lambda: (near, None), 10).collect()
    assert {r["id"] for r in wide} == {5, 6, 7} and wide[0]["id"] == 6


def test_batches(spark):
    got = one(spark, [5, 5, 5, 20, 1], lambda c: answer.batches(c, most_texts=2, most_tokens=10), "array<int>")
    assert got == [0, 0, 1, 2, 3]
    assert one(spark, [], answer.batches, "array<int>") == []


def test_planner_loop(spark):
    tables = spark.createDataFrame([(1, ["A", "Valor"], [["x", "1,5"], ["y", "2"], ["TOTAL", "3,5"]])], "id int, headers array<string>, rows array<array<string>>")
    steps = iter([[0], ("sum_column", {"column": "valor"}), ("nothing", {}), [0]])
    seen, shown = answer.analyse(tables, lambda seen: next(steps))
    assert shown == [0] and seen[0][2] == [(1, "3,50", None)] and seen[1][2] == [(1, None, "unknown tool: nothing")]
    assert answer.analyse(tables, lambda seen: ("count_rows", {}))[0][-1][2] == [(1, "2", None)]


def test_replies(spark):
    assert one(spark, '```json\n[{"page_id": 3, "tags": ["ata"]}]\n```', answer.parse_reply)[0]["tags"] == ["ata"]
    assert one(spark, "none", answer.parse_reply) is None


def test_broken_replies(spark):
    parsed = lambda x: one(spark, x, answer.parse_reply)
    broken = 'Claro: [{"page_id": 7, "tags": ["ata"], {"page_id": 8, "tags": ["receita", "x"]'
    assert [(r["page_id"], r["tags"]) for r in parsed(broken)] == [(7, ["ata"]), (8, ["receita", "x"])]
    assert parsed("nada") is None and parsed(None) is None
    assert [r["page_id"] for r in parsed('```json\n[{"page_id": 1, "tags": ["ata"]}]\n```')] == [1]


def test_links_seen_from_a_page(spark):
    base = "https://a.org/x/y?q=1"
    cases = {"z": "https://a.org/x/z", "/z": "https://a.org/z", "//b.org/z": "https://b.org/z", "http://c/z": "http://c/z", "?p": "https://a.org/x/y?p"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.filter(pages.absolute(F.lit(base), F.col("t")) != F.col("want")).count() == 0
    assert one(spark, "z", lambda c: pages.absolute(F.lit("https://a.org"), c)) == "https://a.org/z"


def test_related_kinds(spark):
    rows = spark.createDataFrame([(1, "pregao", "p"), (2, "pregao", "p"), (3, "date_range", "d"), (1, "date_range", "d")], "id long, entity_type string, entity_value string")
    assert {r["relation_type"] for r in enrich.related(rows, 1, kinds=["origina"]).collect()} == {"origina"}
    assert enrich.related(rows, 1).count() == 4


def test_semantic_of_unknown_kind(spark):
    vectors = spark.createDataFrame([(1, "page", "c", [1.0, 0.0])], "source_id long, source_type string, category string, embedding array<float>")
    assert search.semantic(vectors, "video", [1.0, 0.0], 3).count() == 0
    assert search.semantic(vectors, "page", [1.0, 0.0], 3, "other").count() == 0 and search.semantic(vectors, "page", [1.0, 0.0], 3).count() == 1


def test_page_fields(spark):
    html = """<html><head><title>Título — Portal</title><meta name="description" content="Uma descrição"><meta name="keywords" content="ata, , receita">
      <meta name="DC.date.modified" content="2024-03-01T10:00:00"></head><body><ol id="portal-breadcrumbs"><li><a href="/">Início</a></li><li>Aqui</li></ol>
      <div id="content-core"><nav>fora</nav><p>Texto <b>forte</b></p><a href="a.pdf">Arquivo</a><a href="/b">Página</a><a href="http://other.net/c">Fora</a><a href="/d"></a></div></body></html>"""
    df = spark.createDataFrame([(html, "https://example.org/x/y"), (None, None), ("<h1 class='k documentFirstHeading'>Cabeça</h1><div class='documentDescription'>D</div>", "https://example.org/")], "html string, url string")
    a, b, c = (r["x"] for r in df.select(pages.extract_page("html", "url", "example.org").alias("x")).collect())
    assert (a["title"], a["description"], a["tags"], str(a["last_modified"])[:10]) == ("Título", "Uma descrição", ["ata", "receita"], "2024-03-01")
    assert [tuple(x) for x in a["breadcrumb"]] == [("Início", "https://example.org/"), ("Aqui", "https://example.org/x/y")]
    assert a["main_content"] == a["content_summary"] == "Texto\nforte\nArquivo\nPágina\nFora"
    assert [tuple(x) for x in a["documents"]] == [("https://example.org/x/a.pdf", "Arquivo")] and [tuple(x) for x in a["links"]] == [("https://example.org/b", "Página")]
    assert (b["title"], b["main_content"], b["links"]) == ("", None, []) and (c["title"], c["description"]) == ("Cabeça", "D")
    category = lambda url, place=0: one(spark, url, lambda c: pages.path_category(c, "portal", place))
    assert category("https://a.org/portal/governanca/planos-2024?x") == "Gestão e Governança" and category("https://a.org/portal/governanca/planos-2024", 1) == "Planos 2024"
    assert category("https://a.org/outro/governanca") is None


def test_questions_fall_back(spark):
    known = spark.createDataFrame([("LGPD", 3), ("Licitações e Contratos", 5), ("Licitações, Contratos e Instrumentos de Cooperação", 9), ("x", 99)], "category string, n long")
    assert [r["question"] for r in answer.frequent_questions(known).orderBy("place").collect()] == ["Licitações em andamento", "LGPD e proteção de dados"]
    assert [r["question"] for r in answer.frequent_questions(known.filter("n > 50")).orderBy("place").collect()] == answer.FALLBACK


def test_unknown_files(spark):
    with pytest.raises(ValueError):
        store.tabular(spark, "x.pdf")
