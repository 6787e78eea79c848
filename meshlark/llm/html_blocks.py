"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags.  A
bidirectional LSTM in numpy reads the sequence of their vectors (hashed tag path with class and id
words, hashed words, a few figures) and labels every block with the whole page
as context.  Blocks labelled as article make up the text, in page order.

The model is trained here, on generated pages whose block labels are known (:func:`practice_page`):
wide choice of templates, seeded, bounded by ``PAGES``.  It learns nothing from the input table.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATH_DIM, WORD_DIM, FIGURES, HIDDEN = 192, 48, 10, 24
DIM = PATH_DIM + WORD_DIM + FIGURES
PAGES, EPOCHS = 1300, 9

#: A tag's inside up to its end; quotes hold after an equals sign alone, and nothing is tried twice.
_INSIDE = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]?+)|["'])*+""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
# Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("script style noscript template textarea select option svg math iframe object embed canvas audio video head title datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    """An open element: its name, class, id and role words, and the hash slots of the path down to it as bits."""

    __slots__ = ("name", "slots", "depth", "up")

    def __init__(self, name: str, said: str, up: Node | None):
        self.name, self.up, self.depth = name, up, up.depth + 1 if up else 1
        own = {_slot(f"n:{name}", PATH_DIM), *(_slot(f"c:{w}", PATH_DIM) for w in _WORD.findall(said))}
        self.slots = (up.slots if up else 0) | sum(1 << k for k in own)


class Block:
    __slots__ = ("node", "text", "links", "linked")

    def __init__(self, node: Node | None, text: str, links: int, linked: int):
        self.node, self.text, self.links, self.linked = node, text, links, linked

    @property
    def path(self) -> tuple[str, ...]:
        out, node = [], self.node
        while node:
            out.append(node.name)
            node = node.up
        return tuple(reversed(out))


class _Ends:
    """Where the end tags of skipped elements stand, found from left to right."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def after(self, name: str, pos: int) -> int:
        """Position behind the next end tag of ``name``, -1 for none."""
        if name in self.none:
            return -1
        m = _END_OF[name].search(self.page, pos)
        if not m:
            self.none.add(name)
            return -1
        return m.end()


_END_OF = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>?", re.I) for n in SKIPPED}
_BODY = re.compile(r"<body\b", re.I)


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with a word, in page order, in time that grows with the page's length alone.

    Ends that are left out are implied: a block tag ends an open p, and li, dt, dd, td, th, tr end
    their like.  ``br`` is white space.  Scripts, styles and such are passed over with their content, up to their own end tag
    whatever stands in it; a script, style or textarea that never ends takes the rest of the page, other such elements without an end are no more than a tag.
    A < that no tag, comment or declaration follows is text.
    """
    if not page:
        return []
    out: list[Block] = []
    stack: list[Node] = []
    open_names: dict[str, int] = {}
    buf: list[str] = []
    links = linked = link_depth = 0
    ends, last, pos, size = _Ends(page), page.rfind(">"), 0, len(page)

    def flush() -> None:
        nonlocal links, linked
        if buf:
            raw = "".join(buf)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, links, linked))
            buf.clear()
        links, linked = 0, 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            buf.append(piece)
            if link_depth:
                linked += len(piece)

    def pop(k: int) -> None:
        for n in stack[k:]:
            open_names[n.name] -= 1
        del stack[k:]

    while pos < size:
        at = page.find("<", pos)
        if at < 0 or at > last and not page.startswith("<!", at):
            break
        m = _NAME.match(page, at + 1)
        if not m:
            if page.startswith("<!--", at):
                say(page[pos:at])
                end = page.find("-->", at + 4)
                pos = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                say(page[pos:at])
                end = page.find("]]>", at + 9)
                say(page[at + 9 : size if end < 0 else end])
                pos = size if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?"):
                say(page[pos:at])
                end = page.find(">", at)
                pos = size if end < 0 else end + 1
            else:
                say(page[pos : at + 1])
                pos = at + 1
            continue
        inside = _INSIDE.match(page, m.end())
        end = inside.end()
        if end >= size:  # no end: a quote that never closes takes in the tag alone
            end = page.find(">", m.end())
        say(page[pos:at])
        name, attrs, pos = m[0].lower(), page[m.end() : end], end + 1
        closing = name[0] == "/"
        if closing:
            name = name[1:]
        if name in SKIPPED:
            if not closing and not attrs.endswith("/"):
                end = ends.after(name, pos)
                if name in ("head", "title"):  # passed over up to the end or the body
                    body = _BODY.search(page, pos, end) if end >= 0 else None
                    pos = body.start() if body else end if end >= 0 else pos
                elif end >= 0:
                    pos = end
                elif name in ("script", "style", "textarea"):
                    pos = size  # never closed: the rest of the page belongs to it
            continue
        if name == "br":
            buf.append(" ")
        elif name == "a":
            link_depth = 0 if closing else 1
            links += not closing
        if name not in BLOCKS:
            continue
        flush()
        link_depth = 0
        if closing:
            if open_names.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop(k)
            continue
        if stack and stack[-1].name == "p":
            pop(len(stack) - 1)
        if name in ("li", "dt", "dd", "td", "th", "tr"):
            like = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",)}.get(name, ("table", "tr"))
            if any(open_names.get(x) for x in like):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in stop:
                        break
                    if stack[k].name in like:
                        pop(k)
                        break
        if name != "hr":
            said = " ".join(x for a in _ATTR.finditer(attrs) for x in a.groups()[1:] if x).lower() if "=" in attrs else ""
            stack.append(Node(name, said, stack[-1] if stack else None))
            open_names[name] = open_names.get(name, 0) + 1
    if pos < size:
        say(page[pos:])
    flush()
    return out


def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode()) % dim


def path_bits(node: Node | None) -> int:
    """Hash slots of a tag path as bits: all names, class and id words, and the names of the two nearest elements by their place."""
    bits = node.slots if node else 0
    for k in range(2):
        if node:
            bits |= 1 << _slot(f"{k}:{node.name}", PATH_DIM)
            node = node.up
    return bits


class _Slots(dict):
    """Hash slots of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = k = _slot(word, WORD_DIM)
        return k


def vectors(blocks: list[Block], slots: _Slots | None = None) -> np.ndarray:
    slots = _Slots() if slots is None else slots
    x = np.zeros((len(blocks), DIM), np.float32)
    paths: dict[int, np.ndarray] = {}
    cells: list[int] = []
    scale = np.empty(len(blocks), np.float32)
    for k, b in enumerate(blocks):
        path = paths.get(id(b.node))
        if path is None:
            path = paths[id(b.node)] = np.unpackbits(np.frombuffer(path_bits(b.node).to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little")
        x[k, :PATH_DIM] = path
        words = b.text.lower().split()
        base = k * WORD_DIM
        cells += [base + slots[w] for w in words]
        scale[k] = 1 / max(4, len(words))
        n, t = len(b.text), b.text
        depth = b.node.depth if b.node else 0
        digits = sum(map(t.count, "0123456789"))
        x[k, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 8, min(1.0, b.linked / n), min(1.0, b.links / 4), k / len(blocks), 1 / (k + 1), t[-1] in ".!?", n < 40, min(depth, 24) / 12, digits / n, len(words) < 4)
    if blocks:
        x[:, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(cells, minlength=len(blocks) * WORD_DIM).reshape(len(blocks), WORD_DIM) * scale[:, None]
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"wx{d}"] = (r.standard_normal((DIM, 4 * HIDDEN)) / 8).astype(np.float32)
            self.p[f"wh{d}"] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5 / 2).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
        self.p["wo"] = (r.standard_normal((2 * HIDDEN, 1)) / 4).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states of one direction; x: time, batch, DIM; mask: time, batch."""
        t_max, batch = mask.shape
        pre = x.reshape(-1, DIM) @ self.p[f"wx{d}"] + self.p[f"b{d}"]
        pre = pre.reshape(t_max, batch, -1)
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((t_max, batch, HIDDEN), np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = pre[t] + h @ self.p[f"wh{d}"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g)
            tc = np.tanh(c2)
            h2 = m * o * tc
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], axis=2)
        return _sigmoid(h @ self.p["wo"] + self.p["bo"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keeps = {"f": [], "b": []}
        h = np.concatenate([self._run(x, mask, d, keeps[d]) for d in "fb"], axis=2)
        e = ((_sigmoid(h @ self.p["wo"] + self.p["bo"])[..., 0] - y) * mask / mask.sum()).astype(np.float32)
        g = {"wo": h.reshape(-1, 2 * HIDDEN).T @ e.reshape(-1, 1), "bo": e.sum(keepdims=True).reshape(1)}
        dh_all = e[..., None] * self.p["wo"][:, 0]
        for k, d in enumerate("fb"):
            dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            wh = np.zeros_like(self.p[f"wh{d}"])
            dh = dc = np.zeros((mask.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, tc, m in reversed(keeps[d]):
                dh = (dh + dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN]) * m
                do = dh * tc
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), do * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz_all[t] = dz
                wh += h0.T @ dz
                dh, dc = dz @ self.p[f"wh{d}"].T, dc * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            g |= {f"wx{d}": x.reshape(-1, DIM).T @ flat, f"wh{d}": wh, f"b{d}": flat.sum(0)}
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Article probability of every block of every page."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and e - s < 64 and (e - s + 1) * len(pages[order[e]]) <= 20_000:
                e += 1
            x, mask = padded([pages[k] for k in order[s:e]])
            p = self.probabilities(x, mask)
            for j, k in enumerate(order[s:e]):
                out[k] = p[: len(pages[k]), j]
            s = e
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
        mask[: len(p), j] = 1
    return x, mask


# --- practice pages -------------------------------------------------------

#: Words of class and id names and tags by the role of a region.
ROLES = {
    "menu": (["nav", "ul", "div", "menu"], "nav navbar menu navigation topnav mainmenu breadcrumb breadcrumbs links tabs pagination pager toc skip navi menue hauptmenu menuprincipal navegacion"),
    "header": (["header", "div"], "header masthead topbar site banner logo branding head top kopf entete cabecera"),
    "footer": (["footer", "div", "p"], "footer foot bottom colophon copyright legal site fuss fusszeile pied pie"),
    "sidebar": (["aside", "div", "section"], "sidebar side widget rail secondary related recommended popular trending aside more tags seitenleiste barre lateral"),
    "notice": (["div", "section", "p", "dialog"], "notice cookie cookies consent gdpr alert banner message newsletter popup modal toast subscribe overlay hinweis avis aviso"),
    "advert": (["div", "section", "aside", "p"], "ad ads advert advertisement sponsor sponsored promo promotion adsense adbox banner commercial werbung anzeige publicite publicidad"),
    "form": (["form", "div"], "form search login signup subscribe contact newsletter suche recherche buscar formular"),
    "comments": (["section", "div", "ol", "ul"], "comments comment replies reply respond discussion disqus thread responses feedback reader kommentare commentaires comentarios"),
    "share": (["div", "ul"], "share social sharing buttons follow meta byline author teilen partager compartir"),
}
ARTICLE = (["article", "main", "div", "section"], "article post content entry main story body text page prose single blog news inhalt artikel beitrag contenu contenido texte")
STOCK = {
    "menu": "home about contact news products services blog login menu more next previous archive help start kontakt über accueil produits inicio noticias contacto",
    "header": "welcome menu search site home news daily willkommen bienvenue bienvenido",
    "footer": "copyright rights reserved privacy policy terms contact imprint impressum sitemap powered © datenschutz agb mentions légales confidentialité aviso legal privacidad",
    "sidebar": "related popular recent posts tags archive categories read also more beliebt ähnliche artikel populaires récents recientes",
    "notice": "cookies accept we use this site consent policy agree subscribe newsletter wir verwenden akzeptieren nous utilisons accepter usamos aceptar",
    "advert": "sponsored advertisement buy now offer sale discount click free shop anzeige jetzt kaufen angebot publicité achetez offre publicidad compre oferta",
    "form": "name email password search submit send login subscribe your message absenden suche passwort envoyer rechercher enviar buscar",
    "comments": "reply said comment comments says posted ago like report user antworten kommentar schreibt répondre commentaire responder comentario",
    "share": "share tweet facebook by author published updated posted on teilen von veröffentlicht partager par publié compartir por publicado",
}


def practice_page(seed: int) -> tuple[str, list[bool]]:
    """A generated page and, block by block, whether it is article."""
    r = random.Random(seed)
    syl = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiouéäñ") + r.choice(["", "n", "r", "st"]) for _ in range(1)) for _ in range(40)]
    marks: list[bool] = []
    junk = " ".join(r.choice(("#", "$", "*", "%", "&amp;", "!", "|", "-", "=", "~", "+")) * r.randint(1, 3) for _ in range(r.randint(1, 5))) if r.random() < 0.4 else ""  # odd marks after words
    shout = r.random() < 0.1
    plain = lambda: "".join(r.choice(syl) for _ in range(r.choice((1, 1, 2, 2, 3))))

    def word() -> str:
        w = plain() + (r.choice(junk.split()) if junk and r.random() < 0.8 else "")
        return w.upper() if shout and "&" not in w else w

    sentence = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + r.choice((".", ".", ".", "!", "?"))

    bare, strange = r.random() < 0.15, r.random() < 0.15  # pages without class and id names, or with names that say nothing

    def attrs(names: str, always: bool = False) -> str:
        if bare or (not always and r.random() < 0.3):
            return ""
        if strange and r.random() < 0.8:
            return f' class="{plain()}{r.randint(1, 99)}"'
        picked = r.sample(names.split(), r.choice((1, 1, 2)))
        said = r.choice(("-", "_", " ")).join(picked) + r.choice(("", "", "", "-1", "-box", " clearfix"))
        return f' {r.choice(("class", "class", "id"))}="{said}"'

    def say(role: str) -> str:
        if r.random() < 0.5:
            return sentence(1, 18)
        return " ".join(r.choice((r.choice(STOCK[role].split()), word())) for _ in range(r.randint(1, 9)))

    def block(open_: str, text: str, good: bool) -> str:
        marks.append(good)
        return f"<{open_}>{text}" + ("" if open_.split()[0] in ("p", "li") and r.random() < 0.1 else f"</{open_.split()[0]}>")

    def other(role: str) -> str:
        tags, names = ROLES[role]
        tag = r.choice(tags)
        semantic = tag in ("nav", "footer", "aside", "form", "header")
        head = f"<{tag}{attrs(names, not semantic)}>"
        if role == "menu":
            rows = "".join(block("li", f'<a href="/{word()}">{word() if r.random() < 0.7 else say(role)}</a>', False) for _ in range(r.randint(2, 9)))
            return head + (rows if tag in ("ul", "menu") else f"<ul>{rows}</ul>") + f"</{tag}>"
        body = ""
        if role == "form":
            body = block("p", say(role) + ' <input type="text">', False)
            if r.random() < 0.5:
                body += block("div", "<button>" + r.choice(STOCK[role].split()) + "</button>", False)
            return head + body + f"</{tag}>"
        if tag == "p" or r.random() < 0.4:
            marks.append(False)
            text = say(role)
            if r.random() < 0.4:
                text += f' &middot; <a href="#">{word()}</a>'
            return head + text + f"</{tag}>"
        for _ in range(r.randint(1, 5)):
            inner = r.choice(("p", "p", "div", "li", "h3", "span"))
            if tag in ("ol", "ul"):
                inner = "li"
            text = sentence(4, 40) if role == "comments" and r.random() < 0.7 else say(role)
            if r.random() < 0.4:
                text = f'<a href="/x">{text}</a>'
            if inner == "span":
                inner = "div"
            body += block(inner + (attrs(names) if r.random() < 0.3 else ""), text, False)
        return head + body + f"</{tag}>"

    def article() -> str:
        tag = r.choice(ARTICLE[0])
        wrap = r.random() < 0.4
        alone = r.random() < 0.12  # an article without an element of its own
        out = "" if alone else (f"<div{attrs(ARTICLE[1] + ' container wrapper', True)}>" if wrap else "") + f"<{tag}{attrs(ARTICLE[1], tag in ('div', 'section'))}>"
        if r.random() < 0.85:
            out += block(r.choice(("h1", "h1", "h2")), sentence(2, 10).rstrip(".") + r.choice(("", ".")), True)
        if r.random() < 0.2:
            out += other("share")
        for _ in range(r.choice((1, 2, 3, 5, 8, 13, 20))):
            kind = r.random()
            if kind < 0.82:
                text = sentence(1, 60) if r.random() < 0.8 else sentence(1, 3)
                if r.random() < 0.15:
                    text = f"<b>{text}" + r.choice(("</b>", "<br>"))
                if r.random() < 0.15:
                    text += f' <a href="/{word()}">{word()}</a> {sentence(1, 8)}'
                out += block("p", text, True)
            elif kind < 0.87:
                out += block(r.choice(("h2", "h3")), sentence(1, 6), True)
            elif kind < 0.90:
                tag2 = r.choice(("ul", "ul", "ol"))
                short = r.random() < 0.4
                out += f"<{tag2}>" + "".join(block("li", word() if short and r.random() < 0.7 else sentence(1, 12), True) for _ in range(r.randint(1, 7))) + f"</{tag2}>"
            elif kind < 0.915:
                cols, number = r.randint(2, 4), lambda: r.choice((str(r.randint(0, 2100)), f"{r.random() * 100:.1f}", f"{r.randint(1, 99)} %"))
                out += "<table" + attrs("table data values results wikitable") + ">"
                if r.random() < 0.7:
                    out += "<tr>" + "".join(block(r.choice(("th", "th", "td")), word().capitalize(), True) for _ in range(cols)) + "</tr>"
                for _ in range(r.randint(1, 5)):
                    out += "<tr>" + "".join(block("td", number() if c and r.random() < 0.7 else r.choice((word(), sentence(1, 4))), True) for c in range(cols)) + "</tr>"
                out += "</table>"
            elif kind < 0.925:
                out += "<dl>" + "".join(block("dt", word(), True) + block("dd", sentence(1, 9), True) for _ in range(r.randint(1, 4))) + "</dl>"
            elif kind < 0.935:
                code = "\n".join(f"{word()}{r.choice(('(', ' = ', '.', '[', ': '))}{word()}{r.choice((')', ';', '', ']', ' {'))}" for _ in range(r.randint(1, 8)))
                out += block("pre", r.choice(("", "<code>")) + code, True)
            elif kind < 0.955:
                out += block(r.choice(("blockquote", "pre", "figcaption", "div", "summary", "h4", "caption")), sentence(1, 25), True)
            else:
                out += other(r.choice(("advert", "advert", "sidebar", "share", "notice", "form")))
        if r.random() < 0.15:
            out += other("comments")
        return out + ("" if alone else f"</{tag}>" + ("</div>" if wrap else ""))

    page = f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body>"
    before = [x for x in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < (0.75 if x in ("menu",) else 0.4)]
    r.shuffle(before)
    page += "".join(other(x) for x in before)
    page += article()
    after = [x for x in ("comments", "sidebar", "share", "advert", "notice", "menu", "form") if r.random() < 0.35]
    r.shuffle(after)
    page += "".join(other(x) for x in after)
    if r.random() < 0.85:
        page += other("footer")
    return page + "</body></html>", marks


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """Adam on the logistic loss over generated pages; the same weights on every machine with the same numpy."""
    data = []
    for k in range(pages):
        page, marks = practice_page(seed * 1_000_003 + k)
        blocks = leaf_blocks(page)
        if len(blocks) != len(marks):
            raise AssertionError(f"practice page {k}: {len(blocks)} blocks, {len(marks)} marks")
        data.append((vectors(blocks), np.array(marks, np.float32)))
    data.sort(key=lambda d: len(d[0]))
    batches = [data[s : s + 24] for s in range(0, len(data), 24)]
    net, r = Labeller(seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        for j in r.permutation(len(batches)):
            x, mask = padded([d[0] for d in batches[j]])
            y = np.zeros(mask.shape, np.float32)
            for i, d in enumerate(batches[j]):
                y[: len(d[1]), i] = d[1]
            x = x * (r.random((1, 1, DIM)) > 0.1)  # whole features drop out, so no single one decides
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in net.gradients(x.astype(np.float32), mask, y).items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


_trained: dict[tuple, Labeller] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """One training for each driver process and setting."""
    key = (pages, epochs, seed)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_article of every row.

    ``text`` joins the article blocks by one newline; a null or empty page, or one without an article block, gives
    an empty text.  Pages of any length are read whole.  Repeated rows each give a row, an empty table none; other columns, whatever their names, are ignored.
    """
    weights = (net or trained()).p
    bc = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.__new__(Labeller)
        model.p, slots = bc.value, _Slots()
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                pages = [leaf_blocks(h) for h in b.column(2).to_pylist()]
                probs = model.label([vectors(p, slots) for p in pages])
                texts = ["\n".join(x.text for x, p in zip(blocks, prob, strict=True) if p >= 0.5) for blocks, prob in zip(pages, probs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(1),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([len(p) for p in pages], pa.int64()),
                        pa.array([int((p >= 0.5).sum()) for p in probs], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_article"],
                )

    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_article bigint")
