"""Labelled web pages to train the extraction of main text on.

Pages are put together from common layouts: what an article consists of, and
what stands around it and inside it that is not the article. Every piece of
text carries its label, so that a page's leaf blocks are labelled exactly.
"""

from __future__ import annotations

import html
import random

ARTICLES = ['<article>{}</article>', '<article class="post">{}</article>', '<main>{}</main>', '<main id="content">{}</main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>', '<div class="entry-content">{}</div>', '<div class="post-body">{}</div>', '<section class="story">{}</section>', '<main><article>{}</article></main>', '<div id="main"><div class="article-text">{}</div></div>', '<div role="main">{}</div>', '<table><tr><td class="text">{}</td></tr></table>', '<div>{}</div>', '<article itemscope><div class="body">{}</div></article>', '{}']
MENUS = ['<nav>{}</nav>', '<nav class="navbar">{}</nav>', '<div id="menu">{}</div>', '<div class="nav">{}</div>', '<ul class="breadcrumb">{}</ul>', '<div class="toolbar">{}</div>', '<div role="navigation">{}</div>', '<div class="pagination">{}</div>', '<div class="toc">{}</div>', '<div class="tags">{}</div>', '<ul class="menu">{}</ul>', '<div class="topbar links">{}</div>']
HEADERS = ['<header>{}</header>', '<div id="header">{}</div>', '<header class="site-header">{}</header>', '<div class="masthead">{}</div>', '<div role="banner">{}</div>', '<div class="logo title">{}</div>', '<div class="page-header">{}</div>']
FOOTERS = ['<footer>{}</footer>', '<div id="footer">{}</div>', '<footer class="site-footer">{}</footer>', '<div class="copyright">{}</div>', '<div class="bottom legal">{}</div>', '<div role="contentinfo">{}</div>', '<div class="page-footer">{}</div>']
SIDEBARS = ['<aside>{}</aside>', '<div class="sidebar">{}</div>', '<div id="sidebar-right">{}</div>', '<div class="widget">{}</div>', '<div class="related">{}</div>', '<section class="related-posts">{}</section>', '<div role="complementary">{}</div>', '<div class="side column">{}</div>', '<div class="recommended popular">{}</div>', '<div class="trending more">{}</div>', '<div class="rail">{}</div>', '<div class="right-rail secondary">{}</div>', '<div class="gutter panel">{}</div>', '<div class="module teaser">{}</div>', '<section class="suggestions further">{}</section>']
ADVERTS = ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="advertisement">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>', '<div id="banner-ad">{}</div>', '<aside class="ad">{}</aside>', '<section class="promotion">{}</section>', '<div><ins class="adsby">{}</ins></div>', '<div class="ad-slot box">{}</div>', '<div class="adv commercial">{}</div>']
NOTICES = ['<div class="cookie-notice">{}</div>', '<div id="cookies">{}</div>', '<div class="consent">{}</div>', '<div class="gdpr banner">{}</div>', '<div class="notice">{}</div>', '<div class="alert">{}</div>', '<div class="popup modal">{}</div>', '<div class="newsletter">{}</div>', '<div class="subscribe">{}</div>', '<div role="alert">{}</div>', '<div role="dialog">{}</div>', '<div class="paywall overlay">{}</div>', '<div class="cookie">{}</div>', '<dialog>{}</dialog>', '<div class="warning disclaimer">{}</div>', '<div class="login signup">{}</div>', '<div class="disclosure">{}</div>', '<div class="message info">{}</div>', '<section class="privacy policy">{}</section>', '<div class="toast snackbar">{}</div>', '<div class="disclaimer">{}</div>', '<div class="registration wall">{}</div>']
SHARES = ['<div class="share">{}</div>', '<div class="social">{}</div>', '<ul class="share-buttons">{}</ul>', '<div class="byline meta">{}</div>', '<div class="author-bio">{}</div>']
COMMENTS = ['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="comment-list">{}</ol>', '<section class="comments">{}</section>', '<div id="disqus" class="comment-thread">{}</div>', '<div class="discussion replies">{}</div>', '<div class="responses reviews">{}</div>', '<div class="reader-comments">{}</div>', '<section id="talk">{}</section>', '<div class="feedback">{}</div>', '<div class="thread">{}</div>', '<section class="opinions voices">{}</section>', '<div class="conversation">{}</div>', '<div class="guestbook">{}</div>', '<ul class="messages">{}</ul>']
CUES = {"menu": ["Home", "About us", "Contact", "News", "Sign in", "Log in", "Search", "Archive", "RSS"], "footer": ["© {y} {w}", "Copyright {y} {w}. All rights reserved.", "Privacy policy · Terms of use", "{w} | {w} | {w}", "(c) {y}"], "notice": ["We use cookies to improve {w}.", "Subscribe to our newsletter", "Sign up for {w}", "Please log in to read {w}", "Accept all"], "ad": ["Advertisement", "Sponsored: {w}", "Buy {w} now", "Ad"], "comment": ["Reply", "3 comments", "Leave a comment", "Posted by {w}"], "share": ["Share this", "Follow us", "Tweet", "By {w}, {y}"], "side": ["Related articles", "Read more", "Most popular", "Recent posts"]}


class Writer:
    """Writes one page; ``labels`` gets (text, label) of each block, in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(["aeiounrstlmdk", "aeiouäöüßschnrt", "aeiouñáéíócrdsl", "aeouéèàêrstlmnp", "оеаинтсрвлкм"])
        self.labels: list[tuple[str, int]] = []

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(self.letters) for _ in range(self.r.randint(1, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("....!?") for _ in range(self.r.randint(low, high)))

    def text(self, plain: str, label: int) -> str:
        self.labels.append((" ".join(plain.split()), label))
        out = html.escape(plain, quote=False)
        if self.r.random() < 0.15:
            out = out.replace(" ", self.r.choice(["  ", "\n", "&#32;", "\t "]), 2)
        return out

    def cue(self, kind: str) -> str:
        return self.r.choice(CUES[kind]).format(w=self.words(1, 3), y=self.r.randint(1999, 2025))

    def linked(self, plain: str, label: int) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.text(plain, label)}</a>'

    def paragraph(self, label: int, long: bool = True) -> str:
        r, plain = self.r, self.sentences(1, 7) if long else self.sentences(1, 1)
        if label and r.random() < 0.15:
            plain = self.words(1, 6)  # a few words without a full stop
        body = self.text(plain, label)
        way = r.random()
        if way < 0.08:
            first, _, rest = body.partition(" ")
            body = f'<a href="#">{first}</a> {rest}'
        elif way < 0.2:
            body = f"<b>{body}" + r.choice(["</b>", "", "<br>"])
        elif way < 0.25:
            body = f"<em>{body}</em>"
        return body

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            title = self.text(self.words(2, 12) + r.choice(["", "", "."]), 1)
            out.append(r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", f'<h1 class="title">{title}</h1>', f"<header><h1>{title}</h1></header>"]))
        for _ in range(r.choice([1, 1, 1, 2, 3, 4, 6, 9])):
            way = r.random()
            if way < 0.66:
                out.append(f"<p>{self.paragraph(1, r.random() < 0.85)}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif way < 0.72:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.text(self.words(1, 7), 1)}</h{n}>")
            elif way < 0.79:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>" + "".join(f"<li>{self.paragraph(1, r.random() < 0.3)}</li>" for _ in range(r.randint(2, 5))) + f"</{kind}>")
            elif way < 0.83:
                out.append(f"<blockquote>{self.paragraph(1)}</blockquote>")
            elif way < 0.86:
                out.append(f"<pre>{self.text(self.words(3, 20), 1)}</pre>")
            elif way < 0.89:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.text(self.words(1, 4), 1)}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif way < 0.92:
                out.append(f"<figure><img src=x><figcaption>{self.text(self.words(3, 10), 1)}</figcaption></figure>")
            elif way < 0.94:
                out.append(f"<div>{self.paragraph(1)}</div>")
            elif way < 0.96:
                out.append(f"<details><summary>{self.text(self.words(1, 4), 1)}</summary><p>{self.paragraph(1)}</p></details>")
            elif way < 0.98:
                out.append(f"<xmp>{' '.join(self.literal(1))}</xmp>")
            if r.random() < 0.12:
                out.append(self.clutter())
        if r.random() < 0.12:  # sources, notes: links that belong to the text
            title = f"<h{(n := r.randint(2, 4))}>{self.text(self.words(1, 2), 1)}</h{n}>" if r.random() < 0.7 else ""
            kind = r.choice(["ul", "ol"])
            out.append(title + f"<{kind}>" + "".join(f"<li>{self.linked(self.words(1, 8) + r.choice(['', '.']), 1)}</li>" for _ in range(r.randint(1, 5))) + f"</{kind}>")
        return "".join(out)

    def literal(self, label: int) -> list[str]:
        plain = self.words(2, 12)
        self.labels.append((plain, label))
        return plain.split()

    def links(self) -> str:
        r = self.r
        items = [self.cue("menu") if r.random() < 0.3 else self.words(1, 3) for _ in range(r.randint(1, 8))]
        if r.random() < 0.8:
            return "<ul>" + "".join(f"<li>{self.linked(x, 0)}</li>" for x in items) + "</ul>"
        return " ".join(f"<p>{self.linked(x, 0)}</p>" for x in items)

    def form(self) -> str:
        r = self.r
        return f'<form action="/s"><label>{self.text(self.words(1, 3), 0)}</label><input name=q><div>{self.text(self.words(2, 8), 0)}</div>' + (f"<p>{self.paragraph(0)}</p>" if r.random() < 0.5 else "") + "<select><option>x<option>y</select><button>Go</button></form>"

    def some(self, cue: str) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, 3)):
            way = r.random()
            plain = self.cue(cue) if way < 0.35 else self.words(1, 9) if way < 0.5 else self.sentences(1, 4)
            body = self.text(plain, 0)
            tag = r.choice(["p", "div", "span-alone", "h3", "p"])
            if tag == "span-alone":
                out.append(f"<div><span>{body}</span></div>")
            else:
                out.append(f"<{tag}>{body}</{tag}>")
        return "".join(out)

    def bare(self, cue: str) -> str:
        return self.text(self.cue(cue) if self.r.random() < 0.3 else self.sentences(1, 3) if self.r.random() < 0.8 else self.words(1, 8), 0)

    def wrapped(self, shells: list[str], inner) -> str:
        return self.r.choice(shells).format(inner().replace("{", "(").replace("}", ")"))

    def clutter(self) -> str:
        kinds = [(ADVERTS, "ad"), (ADVERTS, "ad"), (NOTICES, "notice"), (SHARES, "share"), (SIDEBARS, "side")]
        shells, cue = self.r.choice(kinds)
        if self.r.random() < 0.12:
            return self.form()
        return self.wrapped(shells, (lambda: self.bare(cue)) if self.r.random() < 0.5 and "<ul" not in shells[0] else (lambda: self.some(cue)))

    def comments(self) -> str:
        r = self.r

        def inner() -> str:
            out = [f"<h3>{self.text(self.cue('comment'), 0)}</h3>"] if r.random() < 0.6 else []
            for _ in range(r.randint(1, 5)):
                shell = r.choice(['<li class="comment">{}</li>', '<div class="comment">{}</div>', "<article>{}</article>", '<div class="comment-body">{}</div>', "<div>{}</div>", '<div class="reply">{}</div>'])
                body = (f'<p class="author">{self.text(self.words(1, 2), 0)}</p>' if r.random() < 0.5 else "") + f"<p>{self.paragraph(0, r.random() < 0.7)}</p>"
                out.append(shell.format(body))
            return "".join(out)

        return self.wrapped(COMMENTS, inner)

    def page(self) -> str:
        r, out = self.r, []
        hidden = '<script>var t="</p><p>";if(a<b){track(0)}</script>'.replace("{", "(").replace("}", ")")
        if r.random() < 0.75:
            out.append(self.wrapped(MENUS, self.links) if r.random() < 0.6 else self.wrapped(HEADERS, lambda: (f"<h1>{self.text(self.words(1, 3), 0)}</h1>" if r.random() < 0.4 else "") + self.some("menu") + (self.wrapped(MENUS, self.links) if r.random() < 0.5 else "")))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            out.append(self.clutter())
        if r.random() < 0.25:
            out.append(self.wrapped(SIDEBARS, self.links))
        inside, alone = r.random() < 0.2, r.random() < 0.17
        if alone:  # a page that is nothing but its text
            out, self.labels = [], []

        def article() -> str:
            body = self.content()
            return body + (self.comments() if inside else "") + (f"<footer>{self.text(self.cue('footer'), 0)}</footer>" if r.random() < 0.1 else "")

        if alone and r.random() < 0.35:
            short = "".join(f"<p>{self.text(self.words(1, 6), 1)}</p>" for _ in range(r.randint(1, 2)))
            return self.wrapped(["{}", "<html><body>{}</body></html>", "<main>{}</main>", "<article>{}</article>"], lambda: short)
        if alone or r.random() < 0.96:
            out.append(self.wrapped([*ARTICLES, *["{}"] * 8] if alone else ARTICLES, article))
        if alone:
            return self.r.choice(["{}", "<html><body>{}</body></html>"]).format(out[0])
        for _ in range(r.choice([0, 0, 0, 1])):
            out.append(self.clutter())
        if not inside and r.random() < 0.3:
            out.append(self.comments())
        if r.random() < 0.3:
            out.append(self.wrapped(SIDEBARS, lambda: self.some("side") if r.random() < 0.5 else self.links()))
        if r.random() < 0.8:
            out.append(self.wrapped(FOOTERS, (lambda: self.bare("footer")) if r.random() < 0.6 else (lambda: self.some("footer"))))
        body = "".join(out)
        return f"<!DOCTYPE html><html><head><title>x</title><style>p(margin:0)</style>{hidden}</head><body><!-- c -->{body}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, 1 for content)]) of ``count`` pages; the same for the same seed."""
    out = []
    for i in range(count):
        w = Writer(seed * 1_000_003 + i)
        out.append((w.page(), w.labels))
    return out
