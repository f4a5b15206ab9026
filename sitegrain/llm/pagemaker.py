"""Labelled web pages, laid out at random: (html, main text) pairs to train and test extraction.

A page is a row of parts, each in one of several mark-ups: an article with headings,
paragraphs, lists, quotes, tables and figures, and around or inside it menus, headers,
sidebars, notices, adverts, forms, comments and footers.  Words are common ones of
four languages or made of syllables, so none but those of the phrases below tells what a part is.
"""

from __future__ import annotations

import html as _html
import random

# Words by which pages of several languages name their parts.
_PARTS = {
    "nav": "nav navbar navigation menu topnav mainmenu breadcrumb breadcrumbs toc pager pagination skip",
    "header": "header masthead topbar branding logo banner site-header page-header hero-nav tagline",
    "footer": "footer site-footer bottom colophon copyright legal credits imprint page-footer foot",
    "sidebar": "sidebar aside widget widgets rail related recommended recent popular trending teaser more-stories archive tags tagcloud secondary col-right promo-box also-like",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay banner-notice warning toast message disclaimer info-bar paywall",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle dfp banner-ad commercial marketing affiliate",
    "form": "form search searchbox newsletter subscribe signup login register contact feedback poll survey",
    "comments": "comments comment reply respond discussion disqus commentlist thread reader-comments responses feedback-list reviews",
    "share": "share social sharing follow toolbar actions tools buttons print",
}
_CONTENT = "content article post entry story main body text article-body post-content entry-content story-text main-content page-content post-body single prose rich-text"
_NEUTRAL = "container wrapper row inner box col grid layout section block group page site clearfix outer wrap region panel"
_SAID = {
    "nav": ["Home", "About", "Contact", "News", "Blog", "Products", "Accueil", "Actualités", "Startseite", "Über uns", "Kontakt", "Inicio", "Noticias", "Next page", "Previous", "Skip to content"],
    "header": ["Menu", "Welcome", "Search", "Bienvenue", "Willkommen", "Bienvenidos", "Sign in", "Log in", "Subscribe now"],
    "footer": ["All rights reserved.", "© 2024", "Privacy policy", "Terms of use", "Impressum", "Datenschutz", "Mentions légales", "Tous droits réservés.", "Aviso legal", "Powered by", "Copyright", "Alle Rechte vorbehalten.", "Todos los derechos reservados."],
    "sidebar": ["Related articles", "Read more", "Popular posts", "You may also like", "Recent posts", "Tags", "Articles liés", "À lire aussi", "Mehr zum Thema", "Meistgelesen", "Te puede interesar", "Lo más leído", "Archive"],
    "notice": ["We use cookies to improve this site.", "Accept all cookies", "This site uses cookies.", "Nous utilisons des cookies.", "Diese Website verwendet Cookies.", "Este sitio utiliza cookies.", "Accept", "Please enable JavaScript.", "Got it"],
    "ad": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now", "Special offer", "Ad", "Promoted content", "Jetzt kaufen"],
    "form": ["Your email", "Subscribe to our newsletter", "Name", "Password", "Submit", "Send", "Search", "Abonnieren", "S'abonner", "Suscribirse", "Message", "Sign up"],
    "comments": ["Leave a reply", "Reply", "3 comments", "Comments", "Kommentare", "Commentaires", "Comentarios", "Antworten", "Répondre", "Responder", "says:", "Log in to comment"],
    "share": ["Share", "Tweet", "Print", "Email", "Partager", "Teilen", "Compartir", "Follow us"],
}
_COMMON = (
    "the of and to in is that for it with as was on be by this are from at an or we you all our your not have les des et en un une du que est pour dans sur pas nous vous tous ce de la le à au plus "
    "der die das und ist nicht von mit ein eine zu den uns dem alle diese auf im el los y es por con para se su te este todos lo más no"
).split()
_SYLLABLES = "an be co da el fi go hu in ja ka lo mé na or pa qu re sí tu ün va we xo yl zé ár ço".split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        if self.rng.random() < 0.3:
            return self.rng.choice(_COMMON)
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(2, 4)))

    def sentence(self, n: int) -> str:
        out = [self.word() + ("," if self.rng.random() < 0.08 else "") for _ in range(max(1, n))]
        return " ".join(out).capitalize() + self.rng.choice(["."] * 6 + ["!", "?", ":", ""])

    def prose(self) -> str:
        out = " ".join(self.sentence(self.rng.randint(1, 22)) for _ in range(self.rng.choice([1, 1, 2, 3, 5, 8])))
        if self.rng.random() < 0.1:
            out += self.rng.choice([" & more", " < 5", ' "so"', " ***", " ###", " $$$"])
        return out

    def phrase(self, kind: str) -> str:
        return self.rng.choice(_SAID[kind])

    def inline(self, text: str) -> str:
        """Escaped, with inline tags and line breaks put between words."""
        words = [_html.escape(w, quote=self.rng.random() < 0.5) for w in text.split(" ")]
        for _ in range(self.rng.choice([0, 0, 0, 1, 2])):
            k = self.rng.randrange(len(words))
            tag = self.rng.choice(["b", "i", "em", "strong", "a", "span", "code", "u"])
            words[k] = f"<{tag}{' href=/x' if tag == 'a' else ''}>{words[k]}</{tag}>"
        return self.rng.choice([" "] * 8 + ["\n  "]).join(words)

    def named(self, kind: str | None, tags: str) -> tuple[str, str]:
        """Start and end tag of an element that says what it is by tag or by name."""
        tag = self.rng.choice(tags.split())
        names = []
        if kind == "content":
            names = self.rng.sample(_CONTENT.split(), self.rng.choice([0, 1, 1, 2]))
        elif kind:
            least = 1 if tag in ("div", "section", "ul", "table", "td", "p", "span") else 0
            names = self.rng.sample(_PARTS[kind].split(), self.rng.choice([least, 1, 1, 2]))
        if self.rng.random() < 0.25:
            names.append(self.rng.choice(_NEUTRAL.split()))
        said = f' {self.rng.choice(["class"] * 3 + ["id"])}="{" ".join(names)}"' if names else ""
        return f"<{tag}{said}>", f"</{tag}>"

    def links(self, kind: str) -> str:
        items = [self.phrase(kind) if self.rng.random() < 0.3 else self.sentence(self.rng.randint(1, 6)).rstrip(".") for _ in range(self.rng.randint(2, 8))]
        if self.rng.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{k}">{_html.escape(t)}</a>{self.rng.choice(["</li>", ""])}' for k, t in enumerate(items)) + "</ul>"
        return self.rng.choice([" | ", " "]).join(f"<a href=/{k}>{_html.escape(t)}</a>" for k, t in enumerate(items))

    def boilerplate(self, kind: str) -> str:
        """One part that is no main text."""
        r = self.rng
        start, end = self.named(kind, {
            "nav": "nav nav nav div ul div", "header": "header header div", "footer": "footer footer footer div", "sidebar": "aside aside div section", "notice": "div div section aside dialog p",
            "ad": "div div div ins aside section p", "form": "form form div", "comments": "section div div ol", "share": "div ul",
        }[kind])
        body = []
        if kind == "nav":
            body = [self.links("nav")]
        elif kind == "share":
            body = [self.links("share")]
        elif kind == "header":
            body = [r.choice([f"<a href=/>{self.word()}</a>", f"<h1>{self.sentence(2)}</h1>" if r.random() < 0.3 else f"<div>{self.sentence(3)}</div>", f"<p>{self.sentence(7)}</p>"]), r.choice(["", self.links("nav"), self.phrase("header")])]
        elif kind == "footer":
            body = [r.choice(["", "<p>"]) + r.choice([_html.escape(self.phrase("footer")), f"&copy; {self.word()}.example &middot; {self.prose()}", self.prose()]), r.choice(["", self.links("footer")])]
        elif kind == "sidebar":
            body = [f"<h3>{_html.escape(self.phrase('sidebar'))}</h3>" if r.random() < 0.6 else "", r.choice([self.links("sidebar"), f"<p>{self.inline(self.prose())}</p>", f"<div>{self.inline(self.prose())}</div>"])]
        elif kind in ("notice", "ad"):
            said = [self.phrase(kind)] * (r.random() < 0.6) + [self.prose()] * (r.random() < 0.8)
            body = [r.choice(["", "<p>"]) + self.inline(" ".join(said) or self.phrase(kind))]
            body += [f"<button>{_html.escape(self.phrase(kind))}</button>"] * (r.random() < 0.3)
        elif kind == "form":
            body = [f"<p>{_html.escape(self.phrase('form'))}</p>" if r.random() < 0.5 else f"<p>{self.prose()}</p>"]
            body += [f"<label>{_html.escape(self.phrase('form'))} <input name=x></label><button>{_html.escape(self.phrase('form'))}</button>"] * (r.random() < 0.8)
            body += [f"<select><option>{self.word()}<option>{self.word()}</select>"] * (r.random() < 0.2)
        else:
            each = r.choice(["<div class=comment>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<div>{}</div>"])
            body = [f"<h3>{_html.escape(self.phrase('comments'))}</h3>" * (r.random() < 0.7)]
            for _ in range(r.randint(1, 5)):
                who = f"<b>{self.word()}</b> " + r.choice(["", "says:", "<span>2 May</span>"])
                body.append(each.format(who + f"<p>{self.inline(self.prose())}</p>" + r.choice(["", "<a href=#>Reply</a>"])))
        return start + "".join(body) + end

    def article(self) -> tuple[str, list[str]]:
        """Mark-up of an article, and its blocks."""
        r, out, text = self.rng, [], []

        def put(tag: str, said: str, end: bool = True) -> None:
            text.append(" ".join(said.split()))
            out.append(f"<{tag}>{self.inline(said)}" + (f"</{tag.split()[0]}>" if end else ""))

        title = self.sentence(r.randint(1, 9)).rstrip(r.choice([".", ""]))
        if r.random() < 0.9:
            head = r.random() < 0.12
            out.append("<header>" * head)
            put(r.choice(["h1"] * 4 + ["h2"]), title)
            out.append("</header>" * head)
        sloppy = r.random() < 0.25
        for k in range(r.choice([1, 2, 4, 7, 12, 20])):
            kind = r.random()
            if kind < 0.7 or k == 0:
                said = self.prose()
                if sloppy and r.random() < 0.3:
                    text.append(" ".join(said.split()))
                    out.append(f"<p><b>{_html.escape(said)}<br>")
                else:
                    put(r.choice(["p"] * 9 + ["div"]), said, not (sloppy and r.random() < 0.5))
                    if sloppy and not out[-1].endswith(">"):
                        out.append("<p>")
            elif kind < 0.78:
                put(r.choice(["h2", "h3"]), self.sentence(r.randint(1, 7)).rstrip("."))
            elif kind < 0.87:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>")
                for _ in range(r.randint(2, 5)):
                    put("li", self.sentence(r.randint(1, 14)), r.random() < 0.8)
                out.append(f"</{tag}>")
            elif kind < 0.91:
                out.append("<blockquote>")
                put("p", self.prose())
                out.append("</blockquote>")
            elif kind < 0.95:
                out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    out.append("<tr>")
                    for _ in range(r.randint(2, 3)):
                        put(r.choice(["td", "td", "th"]), self.sentence(r.randint(1, 3)))
                    out.append("</tr>")
                out.append("</table>")
            else:
                out.append('<figure><img src="x.png" alt="x">')
                put("figcaption", self.sentence(r.randint(3, 9)))
                out.append("</figure>")
            if r.random() < 0.06:
                out.append(self.boilerplate(r.choice(["ad", "share", "form", "sidebar", "notice"])))
        return "".join(out), text

    def page(self) -> tuple[str, str]:
        r, text = self.rng, []
        parts = []
        for kind, chance in (("notice", 0.25), ("header", 0.5), ("nav", 0.75), ("ad", 0.4), ("form", 0.15), ("sidebar", 0.25)):
            if r.random() < chance:
                parts.append(self.boilerplate(kind))
        r.shuffle(parts)
        if r.random() < 0.93:
            inside, text = self.article()
            start, end = self.named("content", "article article article main main div div section td")
            while r.random() < 0.3:
                tag = r.choice(["main", "div", "section"])
                start, end = f'<{tag} class="{r.choice(_NEUTRAL.split())}">' + start, end + f"</{tag}>"
            if start.startswith("<td"):
                start, end = "<table><tr>" + start, end + "</tr></table>"
            parts.append(start + inside + (self.boilerplate("comments") if r.random() < 0.1 else "") + end)
        for kind, chance in (("share", 0.2), ("comments", 0.3), ("sidebar", 0.4), ("ad", 0.2), ("nav", 0.1), ("form", 0.15), ("notice", 0.1)):
            if r.random() < chance:
                parts.append(self.boilerplate(kind))
        if r.random() < 0.8:
            parts.append(self.boilerplate("footer"))
        if r.random() < 0.3:
            parts = [f'<div class="{r.choice(_NEUTRAL.split())}">', *parts, "</div>"]
        head = f"<!DOCTYPE html><html><head><title>{self.sentence(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        return head + r.choice(["", "\n"]).join(parts) + r.choice(["</body></html>", ""]), "\n\n".join(text)


def pages(count: int, seed: int) -> list[tuple[str, str]]:
    """``count`` pages with their main text, the same for the same seed."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(count)]
