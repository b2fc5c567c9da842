"""The elements of a page as a parser meets them: an interval in document order, and what each holds itself."""

from __future__ import annotations

import re

# Class and id names, roles and limits that the rules speak of.
CHROME_ROLES = {"doc-toc", "navigation", "tooltip", "banner", "contentinfo"}
CHROME_ANYWHERE = {"ambox", "mw-editsection", "mw-jump-link", "siteSub", "contentSub", "jump-to-nav", "mw-portlet-lang", "p-lang-btn"}
CHROME_NAMES = {
    "related-posts", "related-articles", "related-stories", "recommended-posts", "recommended-articles", "post-related", "read-next", "jp-relatedposts",
    "newsletter-signup", "newsletter-form", "subscribe-widget", "subscription-widget", "subscription-widget-wrap", "subscription-box", "post-subscribe", "subscribe-form",
    "cta-section", "share-buttons", "social-share", "sharing-buttons", "post-share", "share-tools", "article-share", "cookie-banner", "cookie-consent-banner",
    "Layout-sidebar", "discussion-sidebar", "toc", "toc-container", "table-of-contents", "article-toc",
}
CHROME_NAMES = {x.lower() for x in CHROME_NAMES}
CONTENT_NAMES = {
    "article", "article-body", "article-content", "article-text", "entry-content", "post-content", "post-body", "blog-post-content", "story-body", "story-content",
    "js-article-content", "article_post", "article-wrapper", "content-article", "instapaper_body",
}
FURNITURE = set(
    "recommend recommended recommendations related share sharing social newsletter newsletters subscribe subscription disclaimer disclaimers promo sponsor sponsored advert "
    "advertisement cookie cookies toc breadcrumb breadcrumbs pagination sidebar widget footer signup comment comments nocontent".split()
)
SCHOLARLY = {"references", "notes", "footnotes", "endnotes", "bibliography", "sources", "citations", "works cited", "acknowledgements", "acknowledgments", "appendix"}
NOTE_NAMES = {"footnotes", "footnote", "endnotes", "references", "bibliography", "notes", "sources"}
SENTENCE = {"p", "li", "dt", "dd", "table", "caption", "figcaption", "blockquote", "pre", "code", "h1", "h2", "h3", "h4", "h5", "h6"}
SEEN = {"time", "img", "picture", "figure", "video", "audio"}
PARAGRAPH = 14  # words of a run as long as a paragraph
CRUMBS, CRUMB_PAGE = (2, 5), 12  # links of a trail, and words of what it ends on
INTRO = 5  # and of a sentence with a colon that introduces what follows
DATA_TABLE = 4  # a table of data says more words than these
MARK_CHARS = 48  # longest text that an element carries as its label

CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿\U00020000-\U0002a6df"
_WORD = re.compile(f"[{CJK}]|[^\\W{CJK}]+")
_HEAD = re.compile("h[1-6]")

SCHEMA = (
    "at int, last int, parent int, depth int, tag string, region string, chrome int, neutral int, furniture int, featured int, "
    "sentence int, chars int, words int, plain int, runs int, links int, heads int, titles int, linked_heads int, seen int, dates int, pictures int, authors int, keep int, "
    "label string, class string, stamp string, own_at int, own_no int, intro int, trail int"
)


def words(text: str) -> int:
    """Letters and digits in runs, CJK characters one by one."""
    return len(_WORD.findall(text))


def _names(a: dict) -> set[str]:
    return {*a.get("class", "").split(), *([a["id"]] if a.get("id") else [])}


def chrome(tag: str, a: dict) -> bool:
    """Page chrome by its role or a complete class or id name."""
    if {"tooltip", "banner"} & set(a.get("role", "").split()) or "popover" in a or _names(a) & CHROME_ANYWHERE:
        return True
    if tag not in ("div", "section", "aside", "nav", "ul", "ol", "footer"):
        return False
    return bool(set(a.get("role", "").split()) & CHROME_ROLES or {n.lower() for n in _names(a)} & CHROME_NAMES)


def region_kind(tag: str, a: dict) -> str:
    role, prop, classes = a.get("role", "").split(), a.get("itemprop", "").split(), a.get("class", "").split()
    if a.get("data-testid") == "issue-viewer-container":
        return "whole"
    if tag == "article" and {"markdown-body", "entry-content"} <= set(classes) and "text" in prop:
        return "whole"
    if tag == "main" or "main" in role:
        return "main"
    if tag == "article" or "articleBody" in prop or "article" in role or (tag in ("div", "section") and {n.lower() for n in _names(a)} & CONTENT_NAMES):
        return "content"
    return ""


def featured(a: dict) -> bool:
    names = (n.split("__")[0].replace("-", "").replace("_", "").lower() for n in _names(a) if len(n) <= 64)
    return any(re.fullmatch("(?:top|featured|hot|best|pinned)comments?", n) for n in names)


class Tree:
    """The elements of one page as they begin and end; number 0 is the page itself."""

    def __init__(self):
        self.nodes, self.stack, self.depths = [], [], {"a": 0, "head": 0}
        self.said, self.runs, self.line = 0, 0, 0
        self.links, self.plain, self.words = 0, 0, 0  # so far
        self.start("#page", {}, False)

    def start(self, tag: str, a: dict, is_chrome: bool) -> int:
        head, link = bool(_HEAD.fullmatch(tag)), tag == "a" and bool(a.get("href"))
        names = {w for n in _names(a) for w in re.split("[-_]", n.lower())}
        node = {
            "at": len(self.nodes), "last": len(self.nodes), "parent": self.stack[-1]["at"] if self.stack else -1, "depth": len(self.stack), "tag": tag, "region": region_kind(tag, a),
            "chrome": is_chrome, "neutral": tag == "aside" or "doc-endnotes" in a.get("role", "") or bool(_names(a) & NOTE_NAMES), "furniture": bool(names & FURNITURE), "featured": featured(a),
            "sentence": tag in SENTENCE, "chars": 0, "words": 0, "plain": 0, "runs": 0, "links": link, "heads": head, "titles": head and not self.depths["a"],
            "linked_heads": (head and self.depths["a"] > 0) or (link and self.depths["head"] > 0), "seen": tag in SEEN, "dates": tag == "time", "pictures": tag in ("img", "picture"),
            "authors": a.get("itemprop") == "author" or (tag == "a" and "author" in a.get("rel", "").lower().split()), "keep": tag in ("pre", "math"), "label": None,
            "class": next(iter(a.get("class", "").split()), None), "stamp": a.get("datetime", "").strip()[:10] if tag == "time" else None, "own_at": -1, "own_no": -1, "intro": 0, "trail": 0,
        }
        node.update(_from=self.said, _text=[], _grid=False, _link=link, _head=head, _steps=[], _links=self.links, _plain=self.plain, _words=self.words)
        self.links += link
        if tag not in ("a", "b", "i", "em", "strong", "span", "code", "time", "small", "abbr", "sub", "sup", "u", "s", "q", "cite", "mark"):
            self.line = 0
        self.nodes.append(node), self.stack.append(node)
        self.depths["a"] += link
        self.depths["head"] += head
        return node["at"]

    def common(self, numbers: set[int]) -> int:
        """The innermost element that holds all of some elements: an element's parent has a smaller number."""
        own = set(numbers)
        while len(own) > 1:
            own.add(self.nodes[last := max(own)]["parent"])
            own.discard(last)
        return own.pop()

    def text(self, run: str) -> int:
        """Notes a run of text; the element that it stands in."""
        node, n = self.stack[-1], words(run)
        plain = n if not self.depths["a"] and not self.depths["head"] else 0
        self.said += len(run.strip())
        self.runs, self.line = self.runs + 1, self.line + n
        node["chars"] += len(run.strip().encode())
        node["words"] += n
        node["plain"] += plain
        self.plain, self.words = self.plain + plain, self.words + n
        node["runs"] += plain >= PARAGRAPH
        node["own_at"], node["own_no"] = len(self.nodes) - 1, self.runs
        node["intro"] = run.rstrip().endswith((":", "：")) and self.line >= INTRO
        for open_ in self.stack:
            if self.said - open_["_from"] <= MARK_CHARS:
                open_["_text"].append(run)
        return node["at"]

    def data_table(self, at: int) -> None:
        self.nodes[at]["_grid"] = True

    def end(self, at: int) -> None:
        while self.stack[-1]["at"] != at:
            self._close(self.stack.pop())
        self._close(self.stack.pop())

    def _close(self, node: dict) -> None:
        node["last"] = len(self.nodes) - 1
        self.depths["a"] -= node["_link"]
        self.depths["head"] -= node["_head"]
        if self.said - node["_from"] <= MARK_CHARS:
            node["label"] = " ".join("".join(node["_text"]).split())
            node["keep"] |= node["_head"] and node["label"].rstrip(":").lower() in SCHOLARLY
        node["keep"] |= node["neutral"] and node["tag"] != "aside"
        if self.stack:  # steps of a trail: one link each, and last the page's own name
            links, plain, said = self.links - node["_links"], self.plain - node["_plain"], self.words - node["_words"]
            step = "step" if links == 1 and not plain else "end" if not links and plain and said <= CRUMB_PAGE else ""
            self.stack[-1]["_steps"].append(step if node["tag"] == "li" else "")
        steps = node["_steps"]
        node["trail"] = node["tag"] in ("ul", "ol") and CRUMBS[0] < len(steps) <= CRUMBS[1] + 1 and steps[-1] == "end" and set(steps[:-1]) == {"step"}
        if node["tag"] not in ("a", "b", "i", "em", "strong", "span", "code", "time", "small", "abbr", "sub", "sup", "u", "s", "q", "cite", "mark"):
            self.line = 0

    def rows(self):
        while self.stack:
            self._close(self.stack.pop())
        for node in self.nodes:
            if node["tag"] == "table" and node["_grid"] and sum(n["plain"] for n in self.nodes[node["at"] : node["last"] + 1]) > DATA_TABLE:
                node["keep"] = True
            if node["tag"] == "header" and not node["chrome"]:
                node["chrome"] = self._banner(node)
            yield tuple(int(v) if isinstance(v, bool) else v for k, v in node.items() if k[0] != "_")

    def _banner(self, header: dict) -> bool:
        """The page's own header, unless a title stands in it outside a link."""
        up, at = header["parent"], None
        while up > 0 and at is None:
            node = self.nodes[up]
            at = node["tag"] if node["tag"] in ("article", "section", "aside", "nav", "main", "figure", "blockquote", "body") or node["region"] == "main" else None
            up = node["parent"]
        inner = self.nodes[header["at"] : header["last"] + 1]
        return at in (None, "body") and not any(n["titles"] and (n["words"] and not n["linked_heads"]) for n in inner)
