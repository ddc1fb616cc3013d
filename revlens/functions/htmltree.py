"""Small element tree over the standard library HTML tokenizer.

Used inside ``mapInPandas`` tasks to pull records and fields out of landed
pages.  It follows the HTML rules that matter for messy pages: void elements,
implied end tags (a new ``<p>``/block closes an open ``<p>``, ``<li>`` closes
an open ``<li>``, table cells and rows), end tags that close any unclosed
children, stray end tags ignored, script/style contents kept as raw text.
Entities are decoded in text and attribute values.
"""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table ul dd dt summary".split()
)
# start tag -> open tags it implicitly closes (searched up to the first of ``stops``)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag = tag
        self.attrs = attrs
        self.children: list = []
        self.parent = parent

    def iter(self):
        """Descendant elements in document order (self excluded)."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        out: list[str] = []
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(out)

    def matches(self, tag: str | None, attrs: dict[str, str] | None) -> bool:
        if tag is not None and self.tag != tag:
            return False
        for k, v in (attrs or {}).items():
            have = self.attrs.get(k)
            if have is None:
                return False
            if k == "class":
                if v != have and v not in have.split():
                    return False
            elif have != v:
                return False
        return True

    def find_all(self, tag: str | None = None, attrs: dict[str, str] | None = None) -> list[Node]:
        return [n for n in self.iter() if n.matches(tag, attrs)]

    def find(self, tag: str | None = None, attrs: dict[str, str] | None = None) -> Node | None:
        for n in self.iter():
            if n.matches(tag, attrs):
                return n
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.stack = [self.root]

    def _close_to(self, idx: int):
        del self.stack[idx:]

    def _find_open(self, tags, stops=()) -> int:
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t in tags:
                return i
            if t in stops:
                return -1
        return -1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            i = self._find_open({"p"}, {"button", "table", "td", "th"})
            if i > 0:
                self._close_to(i)
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            i = self._find_open(closes, stops)
            if i > 0:
                self._close_to(i)
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.stack.pop()

    def handle_endtag(self, tag):
        i = self._find_open({tag})
        if i > 0:
            self._close_to(i)

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    if html:
        b.feed(html)
        b.close()
    return b.root
