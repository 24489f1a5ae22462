"""Captured HTML pages: text, links, headings, embedded postings."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content is not shown, elements without an end tag.
_SKIP = {"script", "style", "noscript", "template", "svg"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end a line of text; those of them that may be the surroundings of a link.
_BLOCK = {"p", "div", "li", "ul", "ol", "br", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}
_AROUND = {"p", "div", "li", "tr", "td", "section", "article"}
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_JSON_SCRIPT = re.compile(r"application/(?:ld\+)?json", re.I)
_ASSIGNED = re.compile(r"\b([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\s*=\s*(?:\1\s*\|\|\s*)?(?=\{)")
#: The widest surroundings of a link, in characters.
_WIDEST = 2_200
#: Words in a link that lead to postings (fixed values).
CAREER = re.compile(r"career|karriere|jobs?\b|stellen|vacanc|join[- ]us|arbeiten bei", re.I)


class _Page(HTMLParser):
    """One pass over a whole page: visible text, links with their surroundings, headings with what follows, embedded objects, marked items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.headings, self.json_ld, self.items, self.literals = [], [], [], [], [], {}
        self.title, self.more, self.upload = "", False, False
        self._open = [{"tag": "", "hidden": False, "at": 0, "item": None}]
        self._raw = None

    def _said(self, at: int) -> str:
        return " ".join("".join(self.text[at:]).split())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        up = self._open[-1]
        hidden = up["hidden"] or tag in _SKIP or "hidden" in a or a.get("aria-hidden") == "true" or bool(_UNSEEN_STYLE.search(a.get("style", "")))
        if tag in _BLOCK:
            self.text.append("\n")
        frame = {"tag": tag, "hidden": hidden, "at": len(self.text), "item": up["item"], "attrs": a, "prop": a.get("itemprop"), "path": up.get("path", ""), "links": len(self.links)}
        self.more |= a.get("rel", "").lower() == "next"
        self.upload |= tag == "input" and a.get("type") == "file" and not hidden
        if "itemscope" in a and not hidden:
            if a.get("itemtype", "").rstrip("/").endswith("schema.org/JobPosting"):
                self.items.append({})
                frame |= {"item": self.items[-1], "path": "", "prop": None}
            elif up["item"] is not None and frame["prop"]:
                frame |= {"path": up.get("path", "") + frame["prop"] + ".", "prop": None}
        if tag == "a" and a.get("href"):
            self.links.append({"href": a["href"], "attrs": a, "hidden": hidden, "at": len(self.text), "text": "", "marked": None, "around": None, "parts": {}})
            frame["link"] = self.links[-1]
        else:
            frame["link"] = up.get("link")
        if tag == "script":
            self._raw = []
        if tag in _VOID:
            self._note(frame)
        else:
            self._open.append(frame)

    def _note(self, f: dict) -> None:
        """What a finished element says: an item's property, a marked part of a link."""
        given = next((f["attrs"][k] for k in ("content", "datetime", "href") if f["attrs"].get(k)), None)
        if f["prop"] and f["item"] is not None and not f["hidden"]:
            f["item"].setdefault(f["path"] + f["prop"], given or self._said(f["at"]))
        link = f.get("link")
        if link and f["tag"] != "a" and not f["hidden"]:
            if f["attrs"].get("data-guide-id"):
                link["parts"].setdefault(f["attrs"]["data-guide-id"].lower(), self._said(f["at"]))
            named = (f["attrs"].get("class", "") + " " + f["attrs"].get("id", "")).lower()
            if "title" in named or "titel" in named or f["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                link["marked"] = self._said(f["at"]) or link["marked"]

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self._open) - 1, 0, -1) if self._open[k]["tag"] == tag), None)
        while at is not None and len(self._open) > at:
            self._shut(self._open.pop())

    def _shut(self, f: dict) -> None:
        tag, own = f["tag"], f.get("link")
        if tag == "script" and self._raw is not None:
            body, self._raw = "".join(self._raw), None
            if _JSON_SCRIPT.match(f["attrs"].get("type", "")) or f["attrs"].get("id", "").lower() in ("__next_data__", "__nuxt_data__"):
                self.json_ld.append(body)
            else:
                self._assigned(body)
        if tag == "title":
            self.title = self.title or " ".join("".join(self.text[f["at"] :]).split())
        if tag == "a" and own and not own["text"]:
            own["text"] = "" if own["hidden"] else self._said(f["at"])
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not f["hidden"]:
            self.headings.append({"level": int(tag[1]), "text": self._said(f["at"]), "end": len(self.text)})
        if tag in _AROUND and not f["hidden"]:
            said = None
            for link in self.links[f["links"] :]:
                if link["around"] is None:
                    said = self._said(f["at"]) if said is None else said
                    if len(self.links) - f["links"] > 1 or len(said) > _WIDEST:
                        link["around"] = ""
                    elif len(said) > len(link["text"]) + 16:
                        link["around"] = said
        self._note(f)
        if tag in _BLOCK:
            self.text.append("\n")

    def _assigned(self, script: str) -> None:
        """Object literals that a script assigns, by name; a name that is assigned twice is ambiguous and empty."""
        for m in _ASSIGNED.finditer(script):
            try:
                value, _ = json.JSONDecoder().raw_decode(script, m.end())
            except (ValueError, RecursionError):
                continue
            self.literals[m[1]] = "{}" if m[1] in self.literals else json.dumps(value)

    def handle_data(self, data):
        if self._raw is not None:
            self._raw.append(data)
        elif not self._open[-1]["hidden"]:
            self.text.append(data)


def parse(html: str | None) -> _Page:
    page = _Page()
    if html:
        page.feed(html)
        page.close()
        while len(page._open) > 1:
            page._shut(page._open.pop())
    return page


def _shown(page: _Page) -> str:
    return " ".join("".join(page.text).split())


def text_of(html: str | None) -> str:
    """The whole visible text."""
    return _shown(parse(html))


def objects(value):
    """All objects in a JSON value, outer first."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
            stack += list(v.values())[::-1]
        elif isinstance(v, list):
            stack += v[::-1]


def embedded_postings(page: _Page, url: str) -> list[dict]:
    out = []
    for block in page.json_ld:
        try:
            found = list(objects(json.loads(block)))
        except (ValueError, RecursionError):
            continue
        for o in found:
            kind = o.get("@type")
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                key = o.get("identifier")
                key = key.get("value") if isinstance(key, dict) else key
                link = _joined(url, str(o.get("url") or ""))
                if o.get("title"):
                    out.append({"external_id": str(key or link), "title": str(o["title"]), "url": link, "date_posted": str(o.get("datePosted") or "")[:10] or None, "valid_through": o.get("validThrough") if isinstance(o.get("validThrough"), str) else None, "description": text_of(str(o.get("description") or "")) or None})
    return out


def _by_page(read, kind: str):
    """``read`` as a column function.  Rows go to Python a hundred at a time, not in Arrow batches of ten thousand: pages, and what is read from them, are large."""
    return F.udf(read, kind, useArrow=False)


def html_text(html: Column) -> Column:
    return _by_page(text_of, "string")(html)


def _best(page: _Page, url: str | None) -> list[dict]:
    out = []
    for link in page.links:
        href, text = link["href"], link["text"]
        full = _joined(url, href)
        out.append({"href": full, "text": text, "score": 60 * bool(CAREER.search(text)) + 40 * bool(CAREER.search(href))})
    return sorted(out, key=lambda x: (-x["score"], len(x["href"]), x["href"], x["text"]))[:60]


def html_links(html: Column, url: Column) -> Column:
    """The 60 links most likely to lead to postings: array<struct<href, text, score>>."""

    return _by_page(lambda h, u: _best(parse(h), u), "array<struct<href:string,text:string,score:int>>")(html, url)


_OBJECT = "struct<external_id:string,title:string,url:string,date_posted:string,valid_through:string,description:string>"
PARTS = (
    "struct<text:string,title:string,links:array<struct<href:string,text:string,marked:string,around:string,hidden:boolean,attrs:map<string,string>,parts:map<string,string>>>,"
    f"best:array<struct<href:string,text:string,score:int>>,headings:array<struct<level:int,text:string,below:string>>,objects:array<string>,items:array<map<string,string>>,literals:map<string,string>,postings:array<{_OBJECT}>,more:boolean,upload:boolean>"
)


def _joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href


def _parts(html: str | None, url: str | None) -> dict:
    page = parse(html)
    text = _shown(page)
    ends = [h["end"] for h in page.headings]
    heads = [{"level": h["level"], "text": h["text"], "below": " ".join("".join(page.text[h["end"] : (ends + [len(page.text)])[k + 1]]).split())} for k, h in enumerate(page.headings)]
    for k, h in enumerate(heads[1:], 1):  # the next heading's words stand at the end of what was below the last
        if h["text"] and heads[k - 1]["below"].endswith(h["text"]):
            heads[k - 1]["below"] = heads[k - 1]["below"][: -len(h["text"])].rstrip()
    found = []
    for block in page.json_ld:
        try:
            found += [json.dumps(o) for o in objects(json.loads(block)) if {"@type", "title", "name", "jobTitle"} & o.keys()]
        except (ValueError, RecursionError):
            continue
    links = [{**{k: x[k] for k in ("text", "marked", "around", "hidden", "attrs", "parts")}, "href": _joined(url, x["href"].strip())} for x in page.links]
    return {"text": text, "title": page.title, "links": links, "best": _best(page, url), "headings": heads, "objects": found, "items": page.items, "literals": page.literals, "postings": embedded_postings(page, url), "more": page.more, "upload": page.upload}


def page_parts(html: Column, url: Column) -> Column:
    """Everything that is read from a page, as one ``PARTS`` struct: each page is parsed once."""

    return _by_page(_parts, PARTS)(html, url)


def inspect_pages(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` with text, links (best 60), headings, postings and a class: postings, career, challenge or other."""
    from vacantia.functions.strings import is_challenge

    u = F.col(url_col)
    p = pages.withColumn("__parts", page_parts(F.col(html_col), u))
    p = p.withColumns({"text": F.col("__parts.text"), "links": F.col("__parts.best"), "headings": F.transform("__parts.headings", lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"))), "postings": F.col("__parts.postings")}).drop("__parts")
    kind = F.when(F.size("postings") > 0, "postings").when(is_challenge(F.left("text", F.lit(2000))), "challenge").when(F.exists("headings", lambda x: x["text"].rlike("(?i)career|karriere|jobs|stellen")) | F.coalesce(u.rlike("(?i)/(?:careers?|karriere|jobs?|stellen)"), F.lit(False)), "career").otherwise("other")
    return p.withColumn("kind", kind)
