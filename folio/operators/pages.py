"""URLs, and what HTML pages hold. Parsing is a pandas UDF over batches; all else is built-in."""

from __future__ import annotations

import re
from datetime import datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.html import parsed

SKIPPED = {"script", "style", "nav", "footer", "header"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
BLOCKS = {"p", "li", "td", "th", "div", "article", "section", "tr", "table", "ul", "ol", *HEADINGS}
EXTRACT = "title string, text string, summary string, links array<string>, headings array<string>"


def normal_url(url: Column) -> Column:
    """Without query, fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")


def content_kind(url: Column) -> Column:
    low = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(low.endswith(".pdf"), "pdf")
        .when(low.endswith(".csv"), "csv")
        .when(low.rlike(r"\.xlsx?$"), "spreadsheet")
        .when(low.contains("docs.google.com/spreadsheets"), "google_sheet")
        .when(low.rlike(r"youtube\.com|youtu\.be|vimeo\.com"), "video")
        .when(low.contains("/api/"), "api")
        .otherwise("page")
    )


# Names of sections by slug.
SLUGS = {
    "gestao-de-pessoas": "Gestão de Pessoas",
    "licitacoes-e-contratos": "Licitações, Contratos e Instrumentos de Cooperação",
    "governanca": "Gestão e Governança",
    "gestao-orcamentaria-e-financeira": "Gestão Orçamentária e Financeira",
    "planos-de-auditoria-interna": "Auditoria",
    "audiencias-publicas": "Audiências e Sessões",
    "colegiados": "Colegiados",
    "contabilidade": "Contabilidade",
    "estatistica-processual": "Estatística Processual",
    "gestao-patrimonial-e-infraestrutura": "Gestão Patrimonial e Infraestrutura",
    "lei-de-acesso-a-informacao-declaracao-anual": "Lei de Acesso à Informação",
    "lgpd-lei-geral-de-protecao-de-dados": "LGPD - Proteção de Dados",
    "ouvidoria": "Ouvidoria",
    "prestacao-de-constas-da-gestao": "Prestação de Contas da Gestão",
    "sei": "SEI - Sistema Eletrônico de Informações",
    "servico-de-informacoes-ao-cidadao-sic": "Serviço de Informação ao Cidadão (SIC)",
    "sustentabililidade_acessibilidade_inclusao": "Sustentabilidade, Acessibilidade e Inclusão",
    "tecnologia-da-informacao-e-comunicacao-1": "Tecnologia da Informação",
    "transparencia-cnj": "Transparência CNJ",
    "relatorios-cnj": "Relatórios CNJ",
}
# Names of categories as they are found, and the ones that they stand for.
CATEGORIES = {
    "Orcamento E Despesas": "Gestão Orçamentária e Financeira",
    "Despesas": "Gestão Orçamentária e Financeira",
    "Receitas": "Gestão Orçamentária e Financeira",
    "Tecnologia Da Informacao E Comunicacao": "Tecnologia da Informação",
    "Contratos": "Licitações, Contratos e Instrumentos de Cooperação",
    "Convenios": "Licitações, Contratos e Instrumentos de Cooperação",
    "Instrumentos De Cooperacao": "Licitações, Contratos e Instrumentos de Cooperação",
    "Gestao De Pessoas": "Gestão de Pessoas",
    "Servidores": "Gestão de Pessoas",
    "Estagiarios": "Gestão de Pessoas",
    "Planejamento E Gestao": "Planejamento e Gestão",
    "Prestacao De Contas": "Prestação de Contas",
    "Auditorias": "Auditoria e Correição",
    "Corregedoria": "Auditoria e Correição",
    "Institucional": "Informações Institucionais",
    "Composicao": "Informações Institucionais",
    "Legislacao": "Legislação e Normas",
    "Resolucoes": "Legislação e Normas",
    "Eleicoes": "Processo Eleitoral",
}


def _named(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def slug_title(slug: Column, names: dict[str, str] = SLUGS) -> Column:
    """The section's name, else the slug with every run of letters capitalised."""
    runs = F.regexp_extract_all(F.translate(slug, "-_", "  "), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.coalesce(_named(names, slug), F.array_join(F.transform(runs, F.initcap), ""))


def canonical_category(name: Column, names: dict[str, str] = CATEGORIES) -> Column:
    """The name that a category stands for; null if it is none of the known ones."""
    return _named(names, name)


def absolute(base: Column, target: Column) -> Column:
    """A link's URL, seen from the page at base: with scheme, from the host, from the root or from the page's folder.

    Steps upwards (..) stay as they are.
    """
    scheme, root = F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*://.*/)", 1)
    link = F.trim(target)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root) + 1, folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


def candidate(url: Column, domain: str, prefix: str) -> Column:
    """The URL to crawl of an absolute link: pages of the domain below prefix without query, files of the domain; else null."""
    host, path = F.regexp_extract(url, r"://([^/?#]*)", 1), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    clean = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(host.contains(domain), F.when(path.contains(prefix), clean).when(path.contains("@@display-file") | path.rlike(r"\.(?:pdf|csv|xlsx|xls)$"), url))


def resolved(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """targets (target) with the page_id of the page (id, url) that has that URL, else of one whose URL ends with it, the smallest id.

    Ends are compared by equality, for the few lengths that unresolved targets have.
    """
    exact = pages.groupBy(F.col("url").alias("target")).agg(F.min("id").alias("exact"))
    first = targets.join(exact, "target", "left")
    rest = first.filter("exact IS NULL AND target <> ''").select("target").distinct()
    sizes = rest.select(F.length("target").alias("size")).distinct()  # as many rows as URLs have lengths
    ends = pages.join(F.broadcast(sizes), F.length("url") >= F.col("size")).select(F.expr("right(url, size)").alias("target"), "id")
    by_end = ends.join(rest, "target", "left_semi").groupBy("target").agg(F.min("id").alias("ending"))
    return first.join(by_end, "target", "left").withColumn("page_id", F.coalesce("exact", "ending")).drop("exact", "ending")


class _Reader(HTMLParser):
    """Collects the visible text by blocks, the title, headings and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.inside = 0, []
        self.title, self.headings, self.links, self.lines, self.line = "", [], [], [], []

    def _end_line(self):
        text = " ".join("".join(self.line).split())
        if text:
            self.lines.append(text)
            if self.inside and self.inside[-1] in HEADINGS:
                self.headings.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag == "br":
            self._end_line()
        if tag in SKIPPED:
            self.hidden += 1
        if tag == "title" or tag in HEADINGS:
            self.inside.append(tag)
        if tag == "a" and (target := dict(attrs).get("href")):
            self.links.append(target)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        if tag in SKIPPED and self.hidden:
            self.hidden -= 1
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data):
        if self.inside and self.inside[-1] == "title":
            self.title += data
        elif not self.hidden:
            self.line.append(data)


def _summary(text: str, most: int = 500) -> str:
    if len(text) <= most:
        return text
    head = text[:most]
    return (head.rsplit(" ", 1)[0] if " " in head else head) + "..."


def _read(html: str | None) -> tuple:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._end_line()
    text = "\n".join(reader.lines)
    return reader.title.split("—")[0].strip(), text, _summary(text), reader.links, reader.headings


def _read_all(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x) for x in html], columns=["title", "text", "summary", "links", "headings"])


def extract(html: Column | str) -> Column:
    """A struct of title, visible text, summary, links and headings of HTML pages."""
    return F.pandas_udf(_read_all, EXTRACT)(html)


PAGE = "title string, description string, breadcrumb array<struct<title:string,url:string>>, main_content string, content_summary string, documents array<struct<url:string,title:string>>, links array<struct<url:string,title:string>>, tags array<string>, last_modified timestamp"
DOCUMENT_ENDS = (".pdf", ".csv", ".xlsx", ".xls")


def _moment(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def _page(html: str | None, url: str | None, domain: str) -> tuple:
    root, url = parsed(html), url or ""
    meta = lambda name: next((e.attrs.get("content") or "" for e in root.below() if e.tag == "meta" and e.attrs.get("name") == name), None)
    heading, titled, described = root.first("h1", **{"class": "documentFirstHeading"}), root.first("title"), root.first("div", **{"class": "documentDescription"})
    title = heading.text("") if heading else titled.text("").split("—")[0].strip() if titled else ""
    trail = root.first("ol", id="portal-breadcrumbs") or root.first("nav", **{"class": "breadcrumb"})
    breadcrumb = []
    for item in (e for e in trail.below() if e.tag == "li") if trail else ():
        link = item.first("a")
        if link or item.text(""):
            breadcrumb.append(((link or item).text(""), urljoin(url, link.attrs.get("href") or "") if link else url))
    core = root.first("div", id="content-core") or root.first("article") or root.first("div", id="content")
    hidden = {"script", "style", "nav", "footer"}
    content = core.text("\n", hidden) if core else None
    files, links = [], []
    for link in (e for e in core.below(hidden) if e.tag == "a" and e.attrs.get("href")) if core else ():
        target, name = urljoin(url, link.attrs["href"]), link.text("")
        if domain in target and name:
            (files if target.lower().endswith(DOCUMENT_ENDS) or "@@display-file" in target else links).append((target, name))
    tags = [k.strip() for k in (meta("keywords") or "").split(",") if k.strip()]
    return title, described.text("") if described else meta("description"), breadcrumb, content, None if content is None else _summary(content), files, links, tags, _moment(meta("DC.date.modified"))


def extract_page(html: Column | str, url: Column | str, domain: str) -> Column:
    """A struct of all that a page of a portal says of itself: PAGE. Links and files are those of domain that have a text."""

    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_page(h, u, domain) for h, u in zip(pages, urls)], columns=[f.split()[0] for f in re.split(r", (?![^<]*>)", PAGE)])

    return F.pandas_udf(run, PAGE)(html, url)


def path_category(url: Column, anchor: str, place: int = 0) -> Column:
    """The name of the section that stands behind anchor in a URL's path, or of the one behind that (place 1); null if there is none."""
    parts = F.split(F.regexp_extract(url, r"^[^?#]*?://[^/?#]*([^?#]*)", 1), "/")
    at = F.array_position(parts, anchor)
    slug = F.get(parts, (at + place).cast("int"))
    return F.when((at > 0) & slug.isNotNull(), slug_title(slug))


def wanted_link(target: Column) -> Column:
    """Not an anchor, script, mail or phone link."""
    return ~F.lower(F.trim(target)).rlike(r"^(?:#|javascript:|mailto:|tel:)") & (F.trim(target) != "")
