"""Labelled pages for training: layouts of common kinds of site, filled with invented words, each with the texts of its content blocks."""

from __future__ import annotations

import random

#: Names that authors of web pages give to parts of a page.
CONTENT_NAMES = "content article post entry story body main text post-content entry-content article-body post-body main-content page-content article-text story-body markdown-body prose".split()
MENU_NAMES = "nav navbar menu main-nav navigation top-nav breadcrumbs breadcrumb pagination pager tabs toc skip-link".split()
HEADER_NAMES = "header site-header masthead top banner page-header branding topbar logo".split()
FOOTER_NAMES = "footer site-footer bottom page-footer copyright colophon legal".split()
SIDE_NAMES = "sidebar side aside widget widget-area rail secondary right-rail related related-posts recommended popular trending most-read archive categories tags tagcloud author-box bio".split()
ADVERT_NAMES = "ad ads advert advertisement sponsored sponsor promo adsbygoogle banner-ad ad-container promoted ad-slot outbrain".split()
NOTICE_NAMES = "notice cookie cookie-banner cookies consent gdpr alert warning modal popup overlay message toast disclaimer privacy cookie-notice".split()
FORM_NAMES = "newsletter subscribe signup search search-form login contact-form comment-form form".split()
COMMENT_NAMES = "comments comment comment-list responses replies discussion disqus comment-body reader-comments".split()
SHARE_NAMES = "share social share-buttons social-links sharing follow".split()
LABELS = ["Home", "About", "Contact", "Log in", "Subscribe", "Share", "Read more", "Privacy", "Terms", "Next", "Menu", "Search", "Reply", "Follow us"]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.wanted, self.terse = rng, [], False
        letters = rng.choice(["aeioustrnlmdk", "aeiouäöüstrnhg", "aéèoustrnlpq", "aeoñíóstrlcd"])
        self.vocabulary = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 9]))) for _ in range(300)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.rng.choice(["."] * 8 + ["!", "?"])

    def prose(self) -> str:
        if self.terse:
            return self.sentence(1, 4)
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 4, 6, 9])))

    def want(self, text: str) -> str:
        self.wanted.append(text)
        return text

    def inline(self, text: str) -> str:
        """Mark up some words; the text stays."""
        words = text.split(" ")
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", '<a href="/x">{}</a>', "<em>{}</em>", "<span>{}</span>", "<code>{}</code>"]).format(words[i])
        return " ".join(words)

    def named(self, names: list[str]) -> str:
        r = self.rng.random()
        name = self.rng.choice(names)
        return f' class="{name}"' if r < 0.6 else f' id="{name}"' if r < 0.85 else f' class="{self.rng.choice(["box", "inner", "c1", "col"])} {name}"'

    def links(self, n: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{i}">{self.rng.choice([self.rng.choice(LABELS), self.words(1, 6)])}</a></{wrap}>' for i in range(n))

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        if kind == "menu":
            return f"<nav><ul>{self.links(rng.randint(3, 9))}</ul></nav>" if rng.random() < 0.6 else f"<div{self.named(MENU_NAMES)}><ul>{self.links(rng.randint(3, 9))}</ul></div>"
        if kind == "header":
            tag = rng.choice(["header", "div"])
            return f"<{tag}{self.named(HEADER_NAMES) if tag == 'div' or rng.random() < 0.4 else ''}><a href='/'>{self.words(1, 3)}</a>{rng.choice(['', f'<p>{self.sentence(2, 8)}</p>', f'<div>{self.words(2, 5)}</div>'])}</{tag}>"
        if kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            inside = rng.choice([f"&copy; {self.words(1, 2)} &middot; {self.sentence(3, 14)}", f"<p>{self.sentence(3, 20)} {self.sentence(3, 20)}</p><p><a href='/p'>Privacy</a></p>", f"<ul>{self.links(4)}</ul><p>&copy; 2024 {self.words(1, 3)}</p>"])
            return f"<{tag}{self.named(FOOTER_NAMES) if tag == 'div' or rng.random() < 0.3 else ''}>{inside}</{tag}>"
        if kind == "side":
            tag = rng.choice(["aside", "div", "section"])
            inside = rng.choice([f"<h3>{self.words(1, 3)}</h3><ul>{self.links(rng.randint(2, 7))}</ul>", f"<h4>{self.words(1, 3)}</h4><p>{self.prose()}</p>", f"<p>{self.sentence()}</p>"])
            return f"<{tag}{self.named(SIDE_NAMES) if tag != 'aside' or rng.random() < 0.5 else ''}>{inside}</{tag}>"
        if kind == "advert":
            inside = rng.choice([self.sentence(3, 14), self.prose(), f"<p>{self.sentence(3, 14)}</p>", f"<a href='//x'>{self.sentence(3, 10)}</a>", f"<p>{self.prose()}</p>"])
            tag = rng.choice(["div", "div", "section"])
            return f"<{tag}{self.named(ADVERT_NAMES)}>{inside}</{tag}>"
        if kind == "notice":
            return f"<div{self.named(NOTICE_NAMES)}>{rng.choice([f'<p>{self.prose()}</p>', self.sentence(5, 25)])}<button>OK</button></div>"
        if kind == "form":
            tag = f"<form{self.named(FORM_NAMES) if rng.random() < 0.5 else ''}>"
            return f"{tag}<label>{self.words(1, 4)}</label><input name='q'>{rng.choice(['', f'<p>{self.sentence(3, 12)}</p>', '<select><option>a<option>b</select>'])}<button>{self.words(1, 2)}</button></form>"
        if kind == "comments":
            tag = rng.choice(["div", "section"])
            one = lambda: rng.choice(["<div class='comment'><b>{}</b><p>{}</p></div>", "<li class='comment'><span>{}</span><p>{}</p></li>", "<article class='comment'><header>{}</header><p>{}</p></article>"]).format(self.words(1, 2), self.prose())
            return f"<{tag}{self.named(COMMENT_NAMES)}><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{tag}>"
        return f"<div{self.named(SHARE_NAMES)}>{self.links(3, 'span')}</div>"

    def content(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.8:
            out.append(f"<h1>{self.want(self.sentence(3, 10)[:-1])}</h1>")
        many = rng.choice([1, 3, 5, 8, 12, 12, 30] + [90] * (rng.random() < 0.3))
        self.terse = rng.random() < 0.25
        plain = rng.random() < 0.4
        for _ in range(many):
            r = rng.random() * (0.62 if plain else 1)
            if r < 0.62:
                text = self.want(self.prose())
                out.append(rng.choice(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<div>{}</div>"]).format(self.inline(text)))
            elif r < 0.72:
                out.append("<h2>{}</h2>".format(self.want(self.words(1, 6))))
            elif r < 0.8:
                items = [self.want(self.sentence(2, 12)) for _ in range(rng.randint(2, 5))]
                out.append("<ul>{}</ul>".format("".join(f"<li>{x}{rng.choice(['</li>', ''])}" for x in items)))
            elif r < 0.86:
                out.append("<blockquote>{}</blockquote>".format(rng.choice(["<p>{}</p>", "{}"]).format(self.want(self.prose()))))
            elif r < 0.9:
                out.append("<pre>{}</pre>".format(self.want(self.words(3, 12))))
            elif r < 0.93:
                out.append("<table><tr><th>{}</th></tr><tr><td>{}</td></tr></table>".format(self.want(self.words(1, 3)), self.want(self.words(1, 5))))
            elif r < 0.95:
                out.append("<figure><img src='x'><figcaption>{}</figcaption></figure>".format(self.want(self.sentence())))
            else:
                out.append(self.boilerplate(rng.choice(["advert", "share", "form", "side", "notice"])))
        self.terse = rng.random() < 0.25
        return "".join(out)

    def build(self) -> str:
        rng = self.rng
        if rng.random() < 0.75:
            # the main part in an element of its own
            tag = rng.choice(["article", "article", "main", "div", "div", "section"])
            name = self.named(CONTENT_NAMES) if tag in ("div", "section") or rng.random() < 0.3 else ""
            inner = self.content() if rng.random() < 0.7 else f"<div{self.named(CONTENT_NAMES)}>{self.content()}</div>"
            main = f"<{tag}{name}>{inner}</{tag}>"
        else:
            main = f"<div>{self.content()}</div>"
        if rng.random() < 0.3:
            main = f"<main>{main}</main>" if rng.random() < 0.5 else f"<div class='{rng.choice(['wrapper', 'container', 'row', 'page'])}'>{main}{self.boilerplate('side')}</div>"
        before = [self.boilerplate(k) for k in ("notice", "header", "menu", "advert", "form", "share") if rng.random() < 0.45]
        after = [self.boilerplate(k) for k in ("share", "advert", "side", "comments", "form", "menu", "notice") if rng.random() < 0.35] + [self.boilerplate("footer")] * (rng.random() < 0.85)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='</p>';</script></head><body>{''.join(before)}{main}<!-- x -->{''.join(after)}</body></html>"


def labelled_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[str]]]:
    """``(html, texts of the content blocks)``; the same for the same arguments."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page = _Page(rng)
        out.append((page.build(), page.wanted))
    return out
