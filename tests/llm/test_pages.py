from html.parser import HTMLParser
from math import sqrt

import pytest
from edge import prose

from changeflow.llm import html_text as H


def para(seed, n=60):
    return f"<p>{prose(seed, n)}, {prose(seed + 9, 30)}.</p>"


def words(html):
    return " ".join(H.unescape(H.re.sub("<[^>]*>", " ", html)).split())


def test_several_articles_stay():
    a, b = para(1) + para(2), para(3, 20)
    assert H.extract(f'<body><nav><a href=x>Home</a></nav><article class="a">{a}</article><article class="b">{b}</article></body>') == words(a + b)


def test_a_form_around_the_article_stays_but_its_controls_go():
    a = "<h1>Title</h1>" + para(1) + para(2)
    page = f'<body><form action=x><div class=top><a href=a>One</a> <a href=b>Two</a></div><div class=c>{a}</div><label>Mail</label><input><select><option>Yes</select></form></body>'
    assert H.extract(page) == words(a)


@pytest.mark.parametrize("name", ["shareholder-notice", "search-results", "comments"])
def test_a_name_alone_drops_nothing(name):
    a = para(1) + para(2)
    assert H.extract(f'<body><div><a href=a>One</a></div><div id="{name}">{a}</div><footer>Foot, note.</footer></body>') == words(a)


def test_inline_elements_are_judged():
    a = prose(3)
    got = H.extract(f'<body><article><p>{a}<span hidden>HIDDEN</span> and<span class="ad">BUY, NOW.</span> so <b>on</b>.</p></article></body>')
    assert got == f"{a} and so on."


def test_short_items_are_judged_with_their_article():
    a = f"<div class=hl><h1>Big Title</h1></div>{para(1)}{para(2)}<ul><li>One</li><li>Two</li></ul><table><tr><td>Cell</td></tr></table>"
    more = "".join(f'<li><a href="{k}">{prose(k, 5)}</a></li>' for k in range(9))
    assert H.extract(f'<body><article>{a}<ul class="more">{more}</ul></article><div class="comments">{para(5) * 9}</div></body>') == words(a)


def test_long_comments_dont_win():
    assert H.extract(f'<body><article><h1>T</h1><p>Short one, here.</p><p>And another one.</p></article><section id="comments">{para(5) * 20}</section></body>') == "T Short one, here. And another one."


class Tree(HTMLParser):
    """Pieces of text with whole paths: tuples of (label, tag, weight, in an article)."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.skip = [("", ("", "", 1.0, False))], [[]], 0
        self.feed(html)
        self.close()

    def cut(self):
        self.blocks.append([])

    def handle_starttag(self, tag, attrs):
        if tag in H.VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag not in H.INLINE:
            if any(t == "p" for t, _ in self.open):
                self.handle_endtag("p")
            self.cut()
        up = self.open[-1][1]
        rest = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in attrs) + ">"
        outside, weight, label = H.says(tag, rest, up[3])
        weight = min(weight, up[2])
        same = tag in H.INLINE and weight == up[2] and not outside
        self.open.append((tag, up if same else (label, tag, weight, up[3] or tag in ("article", "main"), up, outside)))

    def handle_endtag(self, tag):
        at = max((k for k, (t, _) in enumerate(self.open) if t == tag), default=0)
        if at:
            del self.open[at:]
            if tag not in H.INLINE:
                self.cut()

    def handle_data(self, data):
        node, path = self.open[-1][1], []
        while len(node) == 6:
            if node[5]:
                return
            path.append(node[:4])
            node = node[4]
        self.blocks[-1].append((data, tuple(reversed(path)), any(t == "a" for t, _ in self.open)))


def plain(html):
    """The same definitions, path by path over all paths."""
    blocks = Tree(html).blocks
    own = {}
    for b in blocks:
        for p in {p for _, p, _ in b}:
            text = " ".join("".join(t for t, q, _ in b if q == p).split())
            if text:
                linked = " ".join("".join(t for t, q, a in b if q == p and a).split())
                x = own.setdefault(p, [0, 0, 0, 0])
                x[0], x[1], x[2], x[3] = x[0] + len(text), x[1] + len(H._marks(text)), x[2] + 1, x[3] + len(linked)
    if not own:
        return ""

    def region(p):
        heading = bool(p) and p[-1][1] in H.HEADINGS
        for k in range(len(p), 0, -1):
            if p[k - 1][1] in H.REGIONS and not (heading and all(q[-1][1] in H.HEADINGS for q in own if q[:k] == p[:k] and q)):
                return p[:k]
        return ()

    def mean(paths):
        total = sum(own[q][0] for q in paths)
        return [sum(own[q][0] * r for q, r in zip(paths, rs, strict=True)) / total if total else 0.0 for rs in ([own[q][0] / own[q][2] for q in paths], [(own[q][1] + 0.5) / own[q][2] for q in paths])]

    beside = any(p and p[-1][3] and p[-1][2] == 1 for p in own)
    fused, weight = {}, {}
    for p, (n, _, _, a) in own.items():
        r = region(p)
        up = region(r[:-1])
        parts = zip(mean([p]), mean([q for q in own if region(q) == r]), mean([q for q in own if q[: len(up)] == up]), strict=True)
        text, marks = (x / 2 + y / 4 + z / 4 for x, y, z in parts)
        w = (p[-1][2] if p else 1.0) * (H.BESIDE if beside and not (p and p[-1][3]) else 1)
        fused[p], weight[p] = sqrt(text * marks) * (1 - a / n) * w, (n - a) * w
    total = sum(weight.values())
    bar = H.THRESHOLD * sum(fused[p] * weight[p] for p in own) / total if total else -1
    texts = (" ".join("".join(t for t, p, _ in b if p in own and fused[p] >= bar - 1e-12).split()) for b in blocks)
    return " ".join(filter(None, texts))


def test_pages_equal_the_plain_version(spark):
    from edge import SF

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert H.extract(r.html) == plain(r.html)


def test_made_pages_equal_the_plain_version():
    import random

    r = random.Random(4)
    names = ["", ' class="ad"', ' class="text"', ' id="comments"', ' class="x y"', " hidden", ' role="search"']

    def some(depth):
        out = []
        for _ in range(r.randint(1, 4)):
            tag = r.choice(["div", "section", "p", "article", "ul", "h2", "form", "span", "a", "nav"] if depth else ["p", "h3", "li", "span", "a"])
            inner = some(depth - 1) if depth and tag in ("div", "section", "article", "ul", "form", "nav") else prose(r.random(), r.choice([1, 3, 12, 60])) + r.choice(["", ".", " &amp; <b>so, on</b>."])
            out.append(f"<{tag}{r.choice(names)}>{inner}</{tag}>")
        return r.choice(["", " "]).join(out)

    for _ in range(300):
        page = f"<html><body>{some(3)}</body></html>"
        assert H.extract(page) == plain(page), page
