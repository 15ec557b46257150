"""Examples of residue - printed template values, filler, error messages, script notices - and of what resembles it."""

from __future__ import annotations

# Fixed values from which seed examples are made: printed variables, subjects, predicates and notices.
_VARIABLES = "user.name item.price page.title article.body seo.description status.reason http.message cta.label reason message".split()
_FORMS = ("{{{{ {v} }}}}", "{{{{{v}}}}}", "{{% block {v} %}}", "<%= {v} %>", "${{{v}}}", "#{{{v}}}", "%%{u}%%", "@@{u}@@", "[[{u}]]", "???{v}???", "__{u}__", "i18n:{v}", "translation missing: en.{v}", "{{{v}|default}}", "<{w} goes here>", "[Insert {w} here]")
_BARE = ("undefined", "NaN", "null", "null null", "[object Object]", "{0}", "{0} {1}", "%s", "TODO reason", "status.text.missing")
_AROUND = ("{}", "{}", "By {}", "Price: {}", "Welcome, {}!", "Read more about {}", "{} in stock")
_FILLER = (
    "Your text goes here.|This is placeholder text. Replace it with your own words.|Dummy text|Dummy copy for layout only, do not publish.|Sample paragraph, click edit to change it.|Sample status|Insert message|Heading one two three|Add a short description of your business here."
    "|Write something catchy here…|TBD TBD TBD|asdf asdf qwer asdf|xxxx xxx xxxxx xx xxxx|Lorem ipsum dolor sit amet.|lorem ipsum dolor|Hier steht bald ein Blindtext.|Faux texte à remplacer.|Texto de ejemplo para la maqueta."
).split("|")
_WHAT = ("this page", "this document", "that page", "the page you requested", "the page you asked for", "the link you clicked", "the address you followed", "what you were after")
_FAILED = ("could not be found", "could not be loaded", "does not exist", "is no longer available", "is no longer with us", "has been taken down", "leads nowhere", "is gone", "has moved to a new home")
_SERVERS = ("our server", "the application", "the backend", "the gateway")
_GAVE_UP = ("gave up", "did not respond", "ran out of memory", "returned an invalid reply")
_WHEN = ("", " while handling the request", " after 20 seconds", " (code 34)")
_NOTICES = (
    "Sorry, something went wrong on our side|Something broke on our side. Please come back in a few minutes.|We can't seem to find what you're looking for.|Oops! We can't find that page. Try the search box.|Come back soon! Our team is fixing this (ref 9f2c31)|Access denied"
    "|Your request was blocked. Incident 9f2c31aa.|Forbidden|You don't have permission to view this resource.|Service temporarily unavailable|The server is down for maintenance or over capacity.|Too many requests. Slow down and retry in 60 seconds.|Your session has expired, please log in again."
    "|This account has been suspended.|Contact your hosting provider.|Error connecting to the database|502 Bad Gateway|<h1>502 Bad Gateway</h1><hr>proxy|500 – Internal Server Error|<!doctype html><title>Error</title>|Error code 504: upstream timed out (request 9f2c31aa)|Traceback (most recent call last):"
    "|File \"/app/views.py\", line 147, in render|KeyError: 'page_9f2c31aa'|java.lang.NullPointerException|at site.web.PageServlet.doGet(PageServlet.java:55)|Warning: include(header.php): failed to open stream on line 48|<Error><Code>MissingObject</Code><Key>9f2c31aa</Key></Error>|The administrator has been informed."
    "|Try searching, or go home.|Check the spelling and try once more.|Please retry later.|Go to the home page|Report this problem|Error 404|Error 657|Reference: 9f2c31aa|Trace id 9f2c31aa|Session 9f2c31aa|Request 9f2c31aa|proxy/7.4"
    "|Seite nicht gefunden|Die gewünschte Seite existiert nicht oder wurde verschoben.|Leider ist diese Seite nicht erreichbar.|Leider ist der Dienst gerade gestört.|Entschuldigung, ist der Dienst nicht erreichbar.|Fehler 404|Zurück|Kennung 9f2c31aa|Vorgang 9f2c31aa"
    "|Page introuvable|Désolé, cette adresse ne mène nulle part.|Désolé, la page demandée n'est plus disponible.|Aïe, le service a rencontré une panne.|Nous ne trouvons pas cette page, retour à l'accueil|Erreur 404|Retour|Référence 9f2c31aa"
    "|Página no encontrada|Lo sentimos, el contenido ya no está disponible.|Vaya, esta página no está disponible.|Disculpa, el servidor ha fallado.|Código 9f2c31aa|Volver"
    "|JavaScript is required|You need to enable JavaScript to run this app.|Please turn on scripts and reload.|Your browser does not run scripts. The content cannot be shown.|This site works only with scripts and cookies switched on.|Enable scripts to view this page|Nothing can be shown until this is changed."
    "|Loading…|Please wait while we load the application|If nothing happens, allow scripts for this domain.|Checking your browser before you continue…|This takes about 5 seconds.|Verify you are human|noscript: app shell 9f2c31aa|Noscript mode 34|Help: browser settings|Enable scripts to proceed. Check 9f2c31aa"
    "|Bitte JavaScript aktivieren|Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.|Bitte Skripte einschalten.|Bitte Skripte erlauben und neu laden.|Zum Anzeigen JavaScript erlauben und neu laden.|Zum Anzeigen Skripte einschalten."
    "|Veuillez activer JavaScript pour afficher ce contenu.|Debes habilitar JavaScript para ver esta página."
).split("|")
_PURPOSE = ("To view this page", "Before we can continue", "For this app")
_ASK = ("please allow", "please enable", "you must enable", "turn on")
_WHICH = ("JavaScript", "JavaScript and reload", "scripting in your browser")
_BLOCKED = ("JavaScript is disabled", "scripts are blocked")
#: What servers and clients report without its being residue.
REPORTS = (
    "Connection timed out|Connection reset|Connection refused|Connection closed early|Network unreachable|Name not resolved|DNS lookup failed|TLS handshake failed|Proxy handshake failed|Certificate expired 20 days ago|Certificate not trusted|Read timed out after 30 s|Write timed out"
    "|Body incomplete after 20 KiB|Response too large|Too many redirects|Unsupported scheme|Blocked by robots.txt|Broken pipe|Invalid header|Internal Error|Origin Error 20|Site Frozen|Page Expired|Page Moved|Sample Served|Template Rendered|No Reason Phrase|OK (cached)|OK (rendered with JavaScript)|HTTP/2 200|HTTP/1.1 200 OK"
).split("|")
#: Sentences about such things in a real text.
_MENTIONS = (
    "The error 404 tells readers that a page was not found, and a clear message should offer a search box and a way back.|The error 503 tells readers that the service is unavailable for a while, and they should try again later."
    "|If scripts are switched off, the crawler sees an empty page, so enable JavaScript rendering for the whole site.|Write {{ name }} into the theme file and the page prints the visitor's name when it is opened."
    "|An internal server error in 1998 kept visitors from booking the tour for two hours.|Designers once set lorem ipsum in lead type to judge a layout before the copy was written.|A clear page not found message should offer a search box and a way back to the shop."
).split("|")


def seeds() -> list[tuple[str, int]]:
    """Examples made from the fixed values, so that a small sample does not decide what residue looks like."""
    values = [f.format(v=v, u=v.upper().replace(".", "_"), w=v.replace(".", " ")) for v in _VARIABLES for f in _FORMS]
    out = [_AROUND[i % len(_AROUND)].format(v) for i, v in enumerate(values)]
    out += [a.format(v) for v in _BARE for a in _AROUND[1:]] + _FILLER + _NOTICES
    out += [start + (text if start else text[0].upper() + text[1:]) for i, w in enumerate(_WHAT) for j, f in enumerate(_FAILED) for start in (("", "Sorry, ", "Oops, ", "Hmm… ")[(i + j) % 4],) for text in (f"{w} {f}.",)]
    out += [f"{s[0].upper()}{s[1:]} {g}{w}." for s in _SERVERS for g in _GAVE_UP for w in _WHEN]
    out += [f"{p}, {a} {w}." for p in _PURPOSE for a in _ASK for w in _WHICH]
    out += [f"{a} {b} {c}." for a in ("It looks like", "We noticed that") for b in _BLOCKED for c in ("in your browser", "on this device")]
    return [(t, 1) for t in out] + [(t, 0) for t in _MENTIONS * 4]


# Fixed values from which pages are made: furniture, and sentences of plain prose, in four languages.
_MENUS = ("Home|About us|Contact|Search", "Startseite|Kontakt|Suche|Über uns", "Accueil|Contact|Recherche|Boutique", "Inicio|Contacto|Buscar|Tienda")
_CONSENT = ("We use cookies to improve your visit.|Accept all|Settings", "Wir verwenden Cookies.|Alle annehmen|Einstellungen", "Ce site utilise des cookies.|Tout accepter|Refuser", "Usamos cookies en este sitio.|Aceptar todo|Rechazar")
_FEET = ("Terms of use|Privacy|Back to top", "Impressum|Datenschutz|Nach oben", "Mentions légales|Plan du site|Haut de page", "Aviso legal|Privacidad|Volver arriba")
_HEADS = ("The old bridge", "Der alte Hafen", "Le marché couvert", "El puente viejo")
_PROSE = (
    "The bridge was built of oak and has carried the road to the market for more than a hundred years.|Visitors may walk through the garden on weekdays, and a guide explains how the fountain works.|Bring a warm coat, a pair of gloves and something to drink.|Tickets cost 12 crowns, and children come in free.",
    "Der Hafen wurde aus Holz gebaut und dient den Fischern seit mehr als hundert Jahren.|Besucher gehen werktags durch den Garten, und ein Führer erklärt den Brunnen.|Bringen Sie eine warme Jacke und etwas zu trinken mit.|Der Eintritt kostet 12 Kronen, Kinder zahlen nichts.",
    "Le marché a été construit en chêne et accueille les habitants depuis plus de cent ans.|Les visiteurs traversent le jardin en semaine, et un guide explique la fontaine.|Apportez un manteau chaud et de quoi boire.|L'entrée coûte 12 couronnes, gratuite pour les enfants.",
    "El puente se hizo de roble y lleva el camino al mercado desde hace más de cien años.|Los visitantes recorren el jardín entre semana, y un guía explica la fuente.|Traiga un abrigo y algo de beber.|La entrada cuesta 12 coronas, gratis para los niños.",
)


def prose() -> list[str]:
    """Sentences of real texts."""
    return [t for p in _PROSE for t in p.split("|")]


def made_pages() -> list[tuple[str, str, str]]:
    """(url, markup, visible text) of small pages whose markup is unambiguous: each language in three layouts."""
    out = []
    for lang, (menu, consent, foot, head, text) in enumerate(zip(_MENUS, _CONSENT, _FEET, _HEADS, _PROSE)):
        for layout in range(3):
            body = text.split("|")[layout % 2 :]
            tag = ("p", "p", "li")[layout]
            parts = [("nav", "a", menu.split("|"))] + ([("div", "span", consent.split("|"))] if layout else []) + [("main", tag, body), ("footer", "span", foot.split("|"))]
            markup = "".join(f"<{box}>" + (f"<h1>{head}</h1>" if box == "main" else "") + "".join(f"<{t}>{x}</{t}>" for x in lines) + f"</{box}>" for box, t, lines in parts)
            visible = "\n".join([x for box, _, lines in parts for x in ([head] if box == "main" else []) + lines + [""]])
            out.append((f"https://example.test/{lang}/{layout}", f"<html><head><title>{head}</title></head><body>{markup}</body></html>", visible))
    return out
