"""Labelled pages: some written for this package, others made from a rule. What is in an element marked data-main is the article's own text."""

from __future__ import annotations

import random

PAGES = (
    """<html><head><title>Tides</title><style>p{}</style></head><body><header class="site-header"><a href="/">Harbour Post</a></header>
    <nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather today</a></li></ul></nav>
    <article><h1 data-main>Why the tides turn late</h1><p data-main>The moon pulls at the sea, and the sea answers <b>slowly</b>.</p>
    <div class="ad">Buy our boats now</div><p data-main>On a shelving coast the wave of the tide drags along the bottom.</p>
    <p data-main>So high water comes hours after the moon has passed <a href="/m">overhead</a>, and each harbour keeps a table.</p></article>
    <aside><h3>Most read</h3><ul><li><a href="/1">Boats for sale</a></li><li><a href="/2">Ten beaches</a></li></ul></aside>
    <footer>Copyright Harbour Post. All rights reserved.</footer></body></html>""",
    """<html><body class="page"><div id="top"><a href="/">Home</a> <a href="/b">Blog</a> <a href="/c">Contact us</a></div><div id="main" class="content">
    <h2 data-main>Bread with a long rise</h2><p data-main>Mix flour, water, salt and very little yeast in the evening.</p>
    <p data-main>Leave it cold. Fold it once, shape it in the morning.</p><ul><li data-main>five hundred grams of flour</li><li data-main>ten grams of salt</li></ul>
    <blockquote data-main>Patience is the ingredient that nobody sells.</blockquote><p data-main>Bake it hot with steam, then let the crust dry.</p></div>
    <div class="sidebar"><p>Subscribe to our letter</p><form><input name="mail"><button>Send</button></form></div>
    <div id="comments"><p>Anna: lovely, thank you so much!</p><p>Ben: mine went flat, why?</p></div>
    <div class="footer"><a href="/p">Privacy</a> <a href="/i">Imprint</a></div></body></html>""",
    """<html><body><table><tr><td><a href="/a">Index</a> | <a href="/b">Up</a> | <a href="/c">Next page</a></td></tr></table>
    <p data-main>In those years the railway ended at the river, and everything went on by boat.</p>
    <p data-main>The ferryman kept two lamps, one for the train and one for the far bank, and he lit the second one last of all.</p>
    <p data-main>When the bridge was built he bought the lamps from the company.</p><hr>
    <p><a href="/c">Next page</a> <a href="/t">Top</a></p><p><a href="/x">Print</a> <a href="/y">Mail this</a></p></body></html>""",
    """<html><body><div class="cookie-notice">We use cookies. <button>Accept</button></div><main><div class="breadcrumb"><a href="/">Start</a> / <a href="/g">Garden</a></div>
    <section><h1 data-main>Pruning old apple trees</h1><div><p data-main>Take a third of the crown at most, and take it in late winter.</p></div>
    <figure><img src="t.jpg"><figcaption data-main>A tree after the first year.</figcaption></figure>
    <p data-main>Cut to a side branch, never to a stump; a stump rots and the rot goes down.</p></section>
    <section class="related"><h2>More</h2><a href="/1">Pears</a><a href="/2">Plums in spring</a></section></main><footer>Imprint</footer></body></html>""",
    """<html><body><ul class="menu"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three and four</a></li></ul>
    <div><div><p data-main>Glass is not a slow liquid. Old panes are thick below because they were set that way.</p>
    <p data-main>A glazier who has an uneven pane puts the heavy edge down; that is all there is to it.</p>
    <pre data-main>viscosity at room temperature: beyond measure</pre></div></div>
    <div><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a> <a href="/4">Four</a></div></body></html>""",
)


# --- pages made from a rule -------------------------------------------------------------------------------------------

_LANGUAGES = (
    "the of and to in is was for on with as by at from this that it which we had but not they were have one all so there when more would about out into than some time could only new then first any like now over such made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three",
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte gibt alle seit muss wurden beim doch jetzt waren drei jahre neue neuen damit bereits da ab ihr seinen müssen",
    "le la les de des et un une du que qui en dans pour par sur au est pas plus ce se il elle nous vous son sa ses leur avec sans mais ou où comme tout tous cette ces être avoir fait faire dit deux trois temps ans jour homme monde vie main chose petit grand bon même autre encore toujours jamais rien peu très bien aussi après avant entre sous depuis pendant alors ainsi donc quand si déjà moins chaque premier dernier nouveau jeune vieux maison ville pays eau mer terre rue porte nuit",
    "el los las del y una por con para su al lo como más o no son la de que en un se es ha fue ser este esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro otras otra él tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis tú te ti tu casa agua tierra mar noche día hombre mundo vida mano cosa grande bueno",
)
#: (menu, notice, advert, share and related, form, comments, footer, sidebar) phrases.
_CLUTTER = {
    "menu": "Home|News|Sport|Weather today|Contact us|About|Blog|Start|Archive|Startseite|Nachrichten|Kontakt|Über uns|Accueil|Actualités|Contact|Inicio|Noticias|Contacto|Log in|Sign up|Help|FAQ|Shop|Next page|Previous|Top|Print|Mail this|Search|Menu|RSS|Index|Up|Anmelden|Suche",
    "notice": "We use cookies to give you the best experience on our site.|This site uses cookies. By using it you accept our policy.|Wir verwenden Cookies, um Inhalte zu verbessern.|Nous utilisons des cookies pour améliorer votre visite.|Usamos cookies para mejorar su visita.|You are reading the last of your free articles this month.|Please enable scripts to see this page.|Log in or sign up to read more of our stories",
    "ad": "Buy now and save half of the price, today only|Sponsored: the best boats for sale in our shops|Advertisement|Anzeige|Publicité|Publicidad|Buy ten get one free|Our partners have offers for you, click here|Get the app, it is free|Try it for thirty days, then pay by month",
    "share": "Share this|Tweet|Share|Teilen|Partager|Compartir|Like|Follow us|Mail|Send to a friend|Print this page|Save",
    "related": "Related stories|More on this|Read next|Most read|Popular now|Recommended for you|Mehr zum Thema|À lire aussi|Más leídas|You may also like|Trending",
    "form": "Subscribe to our newsletter|Your name and your mail|Write a comment|Your comment here, please be kind|Enter your mail address to get our letter|Leave a reply|Newsletter abonnieren|Send",
    "talk": "Comments|3 comments|12 Kommentare|Commentaires|Comentarios|Reader comments|Responses|Leave a comment|Discussion|Replies",
    "footer": "Copyright {y} {n}. All rights reserved.|© {y} {n}|© {n} · {t}|{n} is not responsible for the content of other sites.|All rights reserved by us|Imprint|Privacy|Terms of use|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by {n}|Last updated {y}|All rights reserved",
    "side": "About the author|Archive|Tags|Categories|Blogroll|Latest posts|Calendar|Poll of the week",
}
_NAMES = {
    "menu": "nav navbar menu main-menu site-nav breadcrumb breadcrumbs topbar toolbar pager pagination skip tabs header-links subnav navigation", "notice": "cookie-notice cookie notice consent gdpr banner alert popup modal overlay paywall message",
    "ad": "ad ads advert adbox ad-slot advertisement sponsored sponsor promo promotion banner-ad adsense", "share": "share share-bar social social-links sharing tools", "related": "related related-posts more-stories recommended popular trending teaser teasers most-read",
    "form": "newsletter subscribe signup search search-box comment-form login", "talk": "comments comment-list comment-thread responses disqus discussion respond", "footer": "footer site-footer foot bottom copyright footer-links legal", "side": "sidebar side widget widgets rail right-column aside widget-area", "head": "header site-header masthead top head logo branding hero",
    "main": "content main article post entry entry-content post-body story story-body text body-text article-body page-content text-block copy chapter part lead intro abstract section-body popular-science social-history",
}
_TAGS = {"menu": "nav", "notice": "div", "ad": "div", "share": "div", "related": "aside", "form": "form", "talk": "section", "footer": "footer", "side": "aside", "head": "header"}


def generated(n: int = 240, seed: int = 5) -> list[str]:
    """n labelled pages of varied build: with or without names and elements that tell, prose of four languages mixed with made-up words, clutter around and inside."""
    rnd = random.Random(seed)
    return [_page(rnd) for _ in range(n)]


def _page(rnd: random.Random) -> str:
    common = rnd.choice(_LANGUAGES).split()
    told, semantic = rnd.random() < 0.6, rnd.random() < 0.5  # whether class words, and elements, tell
    made = lambda: "".join(rnd.choice(("ra", "ten", "lo", "mi", "sche", "ur", "ka", "ion", "é", "bel", "tor", "na", "wi", "est", "go", "pla")) for _ in range(rnd.randrange(1, 5)))
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else made() + (rnd.choice(marks) if marks else "")
    marks = rnd.choice(((), (), (), ("%%%", "&amp;", "***", "###"), ("!!",), (" |",), ("!!", "")))
    case = str.upper if marks and rnd.random() < 0.4 else str.capitalize
    link = lambda t: f'<a href="/{made()}">{t}</a>'

    def say(least: int, most: int, end: str = ".") -> str:
        ws = [word() for _ in range(rnd.randint(least, most))]
        for i in range(6, len(ws), 9):
            ws[i] += rnd.choice((",", ".", "", ""))
        return case(" ".join(ws)) + (rnd.choice("...!?") if end == "." else end)

    def name(kind: str) -> str:
        if not told or rnd.random() < 0.1:
            return ""
        kind = rnd.choice(list(_NAMES)) if kind == "main" and rnd.random() < 0.12 else kind
        return f' {rnd.choice(("class", "class", "id"))}="{rnd.choice(_NAMES[kind].split())}"'

    def box(kind: str, inner: str, plain: str = "div") -> str:
        tag = _TAGS.get(kind, "div") if semantic and rnd.random() < 0.85 else plain
        tag = "form" if kind == "form" and rnd.random() < 0.7 else tag
        return f"<{tag}{name(kind)}>{inner}</{tag}>"

    pick = lambda kind: rnd.choice(_CLUTTER[kind].split("|")).format(y=rnd.randrange(1998, 2025), n=made().capitalize() + rnd.choice((" Post", ".example.com", "", " Ltd")), t=say(4, 14))

    def menu(kind: str = "menu") -> str:
        texts = [rnd.choice((pick("menu"), made(), say(1, 4, ""))) for _ in range(rnd.randint(2, 9))]
        form = rnd.random()
        if form < 0.6:
            return box(kind, "<ul>" + "".join(f"<li>{link(t)}</li>" for t in texts) + "</ul>")
        return box(kind, rnd.choice((" ", " | ", " / ", "")).join(map(link, texts)), rnd.choice(("div", "p", "td", "div")))

    def related() -> str:
        head = f"<h{(k := rnd.randint(2, 4))}>{pick('related')}</h{k}>" * (rnd.random() < 0.8)
        return box("related", head + "<ul>" * (u := rnd.random() < 0.6) + "".join(("<li>" * u) + link(say(2, 8, "")) + "</li>" * u for _ in range(rnd.randint(2, 6))) + "</ul>" * u)

    def talk() -> str:
        one = lambda: box("talk", f"<p>{'<b>' * (b := rnd.random() < 0.5)}{made().capitalize()}{'</b>' * b}{rnd.choice((':', ' says:', ', ' + str(rnd.randrange(1, 28)) + ' May', ' wrote'))}</p><p>{say(4, 30)}</p>" if rnd.random() < 0.5 else f"<p>{made().capitalize()}: {say(4, 25, rnd.choice('!.?'))}</p>")
        return box("talk", f"<h3>{pick('talk')}</h3>" + "".join(one() for _ in range(rnd.randint(1, 5))))

    def form() -> str:
        return box("form", f"<p>{(pick('form') + ' ') * rnd.choice((1, 1, 1, 6, 20))}</p><input name=q><button>{pick('form')}</button>")

    def foot() -> str:
        inner = pick("footer")
        for _ in range(rnd.randrange(3)):
            inner += rnd.choice((" ", " | ", " &middot; ")) + rnd.choice((link(pick("footer")), say(3, 14), pick("footer")))
        return box("footer", rnd.choice((inner, f"<p>{inner}</p>")))

    side = lambda: box("side", f"<h3>{pick('side')}</h3>" + rnd.choice((menu("side"), f"<p>{say(5, 20)}</p>", related(), form())))
    ad = lambda: box("ad", rnd.choice((pick("ad"), f"<p>{pick('ad')}</p>", say(6, 18), link(pick("ad")), f"<p>{say(5, 12)}</p>{link(pick('menu'))}")))
    notice = lambda: box("notice", rnd.choice((pick("notice"), f"<p>{pick('notice')}</p><button>OK</button>", f"{pick('notice')} {link('OK')}")))
    share = lambda: box("share", " ".join(link(pick("share")) for _ in range(rnd.randint(2, 5))))
    head = lambda: box("head", rnd.choice((link(made().capitalize()), f"<div>{link(made())}</div><p>{say(3, 8, '')}</p>", made().capitalize() + " " + say(2, 6, ""))))

    def block() -> str:
        k = rnd.random()
        inline = lambda t: " ".join(rnd.choice((f"<b>{w}</b>", link(w), f"<em>{w}</em>", w + "<br>")) if rnd.random() < 0.04 else w for w in t.split(" "))
        if k < 0.6:
            return f"<p data-main>{inline(say(*rnd.choice(((3, 12), (15, 60), (20, 90)))))}</p>"
        if k < 0.68:
            return f"<h{(h := rnd.randint(2, 4))} data-main>{say(1, 7, '')}</h{h}>"
        if k < 0.76:
            t = rnd.choice(("ul", "ol"))
            return f"<{t}>" + "".join(f"<li data-main>{rnd.choice((say(1, 4, ''), say(3, 20), link(say(1, 4, '')) + ' ' + say(3, 12)))}</li>" for _ in range(rnd.randint(2, 6))) + f"</{t}>"
        if k < 0.82:
            return f"<blockquote data-main>{say(6, 30)}</blockquote>" if rnd.random() < 0.5 else f"<blockquote><p data-main>{say(6, 30)}</p></blockquote>"
        if k < 0.86:
            return f'<figure><img src="{made()}.jpg"><figcaption data-main>{say(2, 12)}</figcaption></figure>'
        if k < 0.9:
            return f"<pre data-main>{say(3, 20, '')}</pre>"
        if k < 0.93:
            return "<table>" + "".join("<tr>" + "".join(f"<td data-main>{say(1, 3, '')}</td>" for _ in range(3)) + "</tr>" for _ in range(rnd.randint(1, 4))) + "</table>"
        if k < 0.96:
            return "<hr>" * rnd.choice((1, 1, 3, 8)) + f"<p data-main>{say(1, 2)}</p>"
        return f"<div data-main>{say(10, 50)}</div>"

    level = rnd.choice((1, 1, 1, 1, 2))
    title = f"<h{level} data-main>{say(1, 9, '')}</h{level}>"
    if rnd.random() < 0.15 and semantic:
        title = f"<header>{title}<p data-main>{say(4, 12)}</p></header>"
    body = [f"<p data-main>{say(1, 12)}</p>"] if rnd.random() < 0.15 else [block() for _ in range(rnd.choice((1, 3, 5, 8, 14)))]
    inside = [x for x in (ad, related, share, form, form, ad, menu) if rnd.random() < 0.13]
    for x in inside:
        body.insert(rnd.randrange(1, len(body) + 1), x())
    if rnd.random() < 0.3:
        cut = rnd.randrange(len(body) + 1)
        body = [f"<section{name('main')}>{''.join(body[:cut])}</section>", f"<section{name('main') if rnd.random() < 0.7 else name('related')}>{''.join(body[cut:])}</section>"]
    wrap = rnd.random()
    core = ("" if rnd.random() < 0.1 else title) + "".join(body)
    if semantic and wrap < 0.75:
        core = f"<article{name('main') * (rnd.random() < 0.4)}>{core}{talk() if rnd.random() < 0.1 else ''}</article>"
    elif semantic and wrap < 0.9:
        core = f"<main>{core}</main>"
    elif wrap < 0.8:
        core = f"<div{name('main')}>{core}</div>"
        core = f"<div>{core}</div>" if rnd.random() < 0.3 else core
    elif wrap < 0.88:
        core = f"<table><tr><td{name('side')}>{menu()}</td><td>{core}</td></tr></table>"
    if rnd.random() < 0.1:  # a page of next to nothing
        return rnd.choice(("", "<body>", "<html><body>")) + f"<p data-main>{rnd.choice((say(1, 5), say(1, 3, ''), word()))}</p>" * rnd.randint(1, 2)
    before = [x() for x in (notice, head, menu, menu, ad, share, form) if rnd.random() < 0.4]
    after = [x() for x in (share, related, ad, talk, side, form, menu) if rnd.random() < 0.3] + [foot()] * (rnd.random() < 0.85)
    page = "".join(before) + core + "".join(after)
    page = f'<form id="aspnetForm" method="post">{page}</form>' if rnd.random() < 0.05 else page
    page = f"<div{name('main') * (rnd.random() < 0.3)}>{page}</div>" if rnd.random() < 0.3 else page
    return f"<!DOCTYPE html><html><head><title>{say(2, 6, '')}</title></head><body>{page}</body></html>"
