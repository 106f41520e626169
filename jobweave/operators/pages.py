"""Pages of postings: blocked responses, listings, details, JSON-LD; Arrow UDFs over the standard parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.sources.schema import FIELDS

# What a challenge page says; elements that begin a line; those without text to show.
CHALLENGE = ("just a moment", "cf-challenge", "captcha", "attention required", "access denied", "checking your browser")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr td th ul".split())
SILENT = frozenset("script style noscript template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def blocked(status: Column, html: Column) -> Column:
    """Whether a response is a refusal: by its status or by a challenge in its first 20,000 characters."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 20_000))
    return F.coalesce(status.isin(401, 403, 503), F.lit(False)) | head.rlike("|".join(re.escape(c) for c in CHALLENGE))


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def all(self, *tags: str, **attrs: str) -> list[Node]:
        has = lambda n: all(v in (n.attrs.get(k.rstrip("_").replace("_", "-")) or "").split() or (v == "" and k.rstrip("_").replace("_", "-") in n.attrs) for k, v in attrs.items())
        return [n for n in self.walk() if (not tags or n.tag in tags) and has(n)]

    def text(self) -> str:
        """Rendered text: a line for each block, blanks run together."""
        out: list[str] = []

        def add(n: Node) -> None:
            if n.tag in SILENT:
                return
            if n.tag in BLOCKS:
                out.append("\n")
            for c in n.children:
                if isinstance(c, str):
                    out.append(re.sub(r"\s+", " ", c))
                else:
                    add(c)
            if n.tag in BLOCKS:
                out.append("\n")

        add(self)
        lines = (re.sub(r"[  ]+", " ", x).strip() for x in "".join(out).split("\n"))
        return "\n".join(x for x in lines if x)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    r = _Reader()
    r.feed(html or "")
    r.close()
    return r.root


def rendered(html: Column) -> Column:
    """The text of a page or fragment; null for null."""

    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else parse(x).text())

    return F.pandas_udf(text, "string")(html)


def json_ld(root: Node) -> dict:
    """The page's first JobPosting, also from lists and graphs; empty if there is none."""
    for n in root.all("script"):
        if n.attrs.get("type", "").lower() != "application/ld+json":
            continue
        try:
            todo = [json.loads("".join(c for c in n.children if isinstance(c, str)))]
        except ValueError:
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                kind = x.get("@type")
                if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                    return x
                todo += x.get("@graph") or []
    return {}


def _place(ld: dict) -> str | None:
    places = ld.get("jobLocation") or []
    names = []
    for p in places if isinstance(places, list) else [places]:
        a = p.get("address") if isinstance(p, dict) else None
        name = a if isinstance(a, str) else (a or {}).get("addressRegion") or (a or {}).get("addressLocality")
        if name and name not in names:
            names.append(name)
    return ", ".join(names) or None


def sections(root: Node) -> dict[str, str]:
    """Heading to the text that follows it, up to the next heading beside it."""
    out: dict[str, str] = {}
    for h in root.all("h2", "h3"):
        siblings = h.parent.children
        body: list[str] = []
        for c in siblings[siblings.index(h) + 1 :]:
            if isinstance(c, Node) and c.tag in ("h2", "h3"):
                break
            body.append(c.strip() if isinstance(c, str) else c.text())
        if name := h.text().strip().lower():
            out.setdefault(name, "\n".join(x for x in body if x))
    return out


DESCRIPTION = re.compile(r"mô tả|description|what you|about the (role|job)|trách nhiệm", re.I)
REQUIREMENT = re.compile(r"yêu cầu|requirement|qualification|your skills|kỹ năng|profile", re.I)
EXPERIENCE = re.compile(r"(?:(?:ít nhất|trên|dưới|at least|over)\s+)?\d+\s*(?:[-–]\s*\d+)?\s*\+?\s*(?:năm|years?)(?:\s+kinh nghiệm|\s+of experience)?|không yêu cầu kinh nghiệm|no experience", re.I)


def detail(url: str, html: str | None, source: str, at: str | None, version: str) -> dict:
    """A page's record: JSON-LD first, then headings and sections; what isn't there is null."""
    import hashlib

    root = parse(html)
    ld, found = json_ld(root), sections(root)
    pick = lambda p: next((t for h, t in found.items() if p.search(h) and t), None)
    h1 = next((t for t in (n.text() for n in root.all("h1")) if t), None)
    title = ld.get("title") or h1
    org = ld.get("hiringOrganization")
    company = org.get("name") if isinstance(org, dict) else org
    body = pick(DESCRIPTION) or (parse(ld["description"]).text() if ld.get("description") else None)
    seen = EXPERIENCE.search(root.text())
    ident = ld.get("identifier")
    row = dict.fromkeys(FIELDS)
    row |= {"job_id": hashlib.sha256(url.encode()).hexdigest()[:16], "source": source, "source_job_id": str(ident.get("value")) if isinstance(ident, dict) and ident.get("value") is not None else ident if isinstance(ident, str) else None, "source_url": url, "crawl_timestamp": at, "parser_version": version}
    row |= {"raw_job_title": title, "company": company, "raw_location": _place(ld), "posted_date": (ld.get("datePosted") or "")[:10] or None, "raw_experience": seen.group() if seen else None, "job_description": body, "job_requirements": pick(REQUIREMENT)}
    return row


RAW = [f for f in FIELDS if f not in ("relevance_flag", "duplicate_flag", "extracted_skills", "skill_count")]


def details(pages: DataFrame, url: str = "url", html: str = "html", source: str = "web", version: str = "v1", code: str | None = None, at: str | None = None) -> DataFrame:
    """The pages' records with status, http_status and error: SUCCESS, or HTTP_ERROR by the response's code, ACCESS_BLOCKED for a refusal, PARSE_ERROR for a page
    that can't be read, VALIDATION_ERROR for one without a title. code and at name the columns of the response's code and time, if there are any."""
    number = pages[code].cast("int") if code else F.lit(None).cast("int")
    refused = blocked(number, pages[html])
    rows = pages.select(pages[url].alias("u"), pages[html].alias("h"), number.alias("c"), refused.alias("b"), (pages[at].cast("string") if at else F.lit(None).cast("string")).alias("t"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for u, h, c, b, t in pdf.itertuples(index=False):
                c = None if pd.isna(c) else int(c)
                row, error = dict.fromkeys(FIELDS) | {"source": source, "source_url": u, "crawl_timestamp": t, "parser_version": version}, None
                if b:
                    status = "ACCESS_BLOCKED"
                elif c is not None and c >= 400:
                    status = "HTTP_ERROR"
                else:
                    try:
                        row = detail(u, h, source, t, version)
                        status = "SUCCESS" if row["raw_job_title"] else "VALIDATION_ERROR"
                    except Exception as e:  # a page may hold anything
                        status, error = "PARSE_ERROR", f"{type(e).__name__}: {e}"
                out.append([row[f] for f in RAW] + [status, c, error])
            yield pd.DataFrame(out, columns=[*RAW, "status", "http_status", "error"]).astype({"http_status": "Int32"})

    return rows.mapInPandas(read, ", ".join(f"{f} string" for f in [*RAW, "status"]) + ", http_status int, error string")


def crawl_log(found: DataFrame) -> DataFrame:
    """The log of a crawl, a row for each page: (source, source_url, crawl_timestamp, status, http_status, error_type, error_message, parser_version)."""
    message = F.coalesce("error", F.when(F.col("status") == "HTTP_ERROR", F.concat(F.lit("HTTP "), F.col("http_status"))))
    kind = F.when(F.col("status") != "SUCCESS", F.coalesce(F.regexp_extract("error", r"^(\w+):", 1), F.col("status")))
    return found.select("source", "source_url", "crawl_timestamp", "status", "http_status", kind.alias("error_type"), message.alias("error_message"), "parser_version")


def hints(pages: DataFrame, patterns: dict[str, str], url: str = "url", html: str = "html", most: int = 12, longest: int = 140) -> DataFrame:
    """(page, kind, rank, text, path): short texts of a page that fit one of the patterns, with the tags they stand in; for whoever mends a parser.

    The first `most` for each kind, each text once at its place; texts over `longest` characters are no hints.
    """

    def where(n: Node | None, depth: int) -> str:
        out = []
        while n is not None and n.tag not in ("", "html", "body") and len(out) < depth:
            name = n.tag + ("#" + n.attrs["id"] if n.attrs.get("id") else "")
            name += "".join("." + c for c in n.attrs.get("class", "").split()[:3])
            data = [k for k in n.attrs if k.startswith("data-")][:2]
            out.append(name + (f"[{','.join(data)}]" if data else ""))
            n = n.parent
        return " < ".join(out)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {k: re.compile(p, re.I) for k, p in patterns.items()}
        for pdf in batches:
            out = []
            for u, h in pdf.itertuples(index=False):
                seen: dict[tuple, int] = {}
                for n in parse(h).walk():
                    for t in () if n.tag in SILENT else (" ".join(c.split()) for c in n.children if isinstance(c, str)):
                        for kind, p in compiled.items():
                            key = (kind, t, where(n, 2))
                            if t and len(t) <= longest and key not in seen and sum(k[0] == kind for k in seen) < most and p.search(t):
                                seen[key] = sum(k[0] == kind for k in seen) + 1
                                out.append((u, kind, seen[key], t, where(n, 4)))
            yield pd.DataFrame(out, columns=["page", "kind", "rank", "text", "path"])

    return pages.select(url, html).mapInPandas(read, "page string, kind string, rank int, text string, path string")


def listing(html: str | None, base: str) -> tuple[list[tuple[str, str]], str | None]:
    """(address, title) of the postings of a result page, each once, and the next page."""
    root = parse(html)
    cards = [n for n in root.walk() if "data-job-id" in n.attrs or "job" in n.attrs.get("class", "").split()]
    seen: dict[str, str] = {}
    for card in cards or [root]:
        for a in card.all("a"):
            if a.attrs.get("href") and a.text():
                seen.setdefault(urljoin(base, a.attrs["href"]).split("#")[0], a.text())
                if cards:
                    break
    following = next((a.attrs["href"] for a in root.all("a", "link") if "next" in a.attrs.get("rel", "").split() and a.attrs.get("href")), None)
    return list(seen.items()), urljoin(base, following) if following else None


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, link, title), each link once a page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, x, t) for u, h in pdf.itertuples(index=False) for x, t in listing(h, u)[0]], columns=["page", "link", "title"])

    return pages.select(url, html).mapInPandas(read, "page string, link string, title string")
