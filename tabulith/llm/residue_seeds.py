"""Training texts for residue models: what unfilled, filler and error texts look like.

The texts are examples for fitting character n-gram models, not patterns to be matched. They
are made from common knowledge of servers, browsers, word processors and spreadsheets by
combining everyday wording; none is taken from a corpus.
"""

from __future__ import annotations

from http import HTTPStatus
from itertools import product


def _every(*parts: str | tuple[str, ...], step: int = 1) -> list[str]:
    """Sentences from alternatives, of which every step-th is kept."""
    choices = [(p,) if isinstance(p, str) else p for p in parts]
    return [" ".join(w for w in combined if w).replace(" .", ".").replace(" ,", ",") for combined in product(*choices)][::step]


def notices() -> list[str]:
    """Messages of servers, access checks, scripts, cookies and robot checks."""
    out = []
    for status in HTTPStatus:
        if status.value >= 400:
            out += [f"{status.value} {status.phrase}", f"{status.phrase} ({status.value})", f"HTTP {status.value}: {status.phrase}", f"Error {status.value}", f"Error {status.value}: {status.phrase}"]
            if status.description:
                out.append(f"{status.description}.")
    thing = ("page", "document", "file", "article", "address", "resource")
    again = ("", "Please try again later.", "Try again in a few minutes.", "Go back to the home page.", "Return to the start page.", "Check the address and try again.", "Please reload the page.")
    out += _every("The", thing, ("you asked for", "you are looking for", "you requested"), ("could not be found.", "does not exist.", "is not available.", "has been moved or deleted.", "cannot be displayed."), again, step=7)
    out += _every(("Page", "Document", "File"), ("not found.", "not available.", "cannot be displayed."))
    out += _every(("The requested URL", "The requested page", "Your request"), ("was not found on this server.", "was rejected.", "was blocked.", "could not be processed.", "timed out."), ("", "Your support ID is 1234567890.", "Reference number 12345.", "Request ID 123456."))
    out += _every(("This site", "This service", "The server", "The database", "The website"), ("is temporarily unavailable.", "is down for maintenance.", "is currently unavailable.", "is not responding.", "is under construction."), ("", "Please try again later.", "We will be back soon.", "We apologise for the inconvenience."))
    out += _every(("Oops!", "Sorry,", ""), ("something went wrong", "an error occurred", "an unexpected error occurred", "we could not load this page"), ("while loading the page.", "on our side.", "."), ("", "Please try again.", "Refresh the page or try again later."), step=2)
    out += _every(("Access", "Permission", "Access to this page"), ("denied.", "forbidden.", "is restricted.", "has been denied.", "has been blocked."))
    out += _every("You", ("do not have permission", "are not authorised", "are not allowed", "need permission"), ("to view", "to access", "to open"), ("this page.", "this document on this server.", "this resource."), step=2)
    out += _every(("Your IP address", "Your account", "Your connection"), ("has been blocked.", "has been suspended.", "was refused."))
    out += _every(("Your session", "Your login", "This link"), ("has expired.", "has timed out.", "is no longer valid."), ("", "Please sign in again.", "Please log in to continue."))
    out += _every(("Please", ""), ("sign in", "log in", "register", "subscribe"), ("to continue.", "to read the full text.", "to view this content.", "to access this article."), step=2)
    out += _every(("Fatal error:", "Warning:", "Error:", "Notice:"), ("uncaught exception", "undefined variable", "undefined index", "call to undefined function", "cannot connect to database"), ("in index.php on line 12.", "in /var/www/html/page.php on line 345", "in main() at line 67."), step=2)
    out += ["Traceback (most recent call last):", 'File "main.py", line 12, in <module>', "TypeError: cannot read property of undefined", "java.lang.NullPointerException at Main.java:12", "Segmentation fault (core dumped)", "Connection timed out.", "Connection refused.", "Error establishing a database connection.", "Database connection failed.", "Too many connections.", "Stack trace:", "Internal error.", "No route to host."]
    needed = ("JavaScript", "scripts", "cookies", "JavaScript and cookies")
    turn = ("enable", "turn on", "activate", "allow", "switch on")
    out += _every(("Please", "You must", "You need to", "To continue, please", ""), turn, needed, ("to view this page.", "in your browser.", "to continue.", "to use this site.", "and reload the page.", "for this site."), step=7)
    out += _every(needed, ("must be enabled", "must be switched on", "must be allowed"), ("to view this page.", "to read this article.", "in your browser."), step=2)
    out += _every(("JavaScript is", "Cookies are", "Scripts are"), ("required", "disabled", "blocked", "turned off", "needed"), ("in your browser.", "to view this page.", "to use this site.", "to read this article.", "."), ("", "Please turn it on and reload."), step=3)
    out += _every(("This site", "This page", "This application", "This viewer"), ("requires", "needs", "does not work without"), ("JavaScript", "cookies", "scripts"), ("to run.", "to work.", "."), step=3)
    out += _every("Your browser", ("does not support scripts.", "is not supported.", "is out of date.", "blocks cookies.", "does not accept cookies.", "cannot display this page.", "has JavaScript turned off."), ("", "Please update your browser.", "Please use another browser."))
    out += _every(("Loading", "Loading...", "Please wait..."), ("", "If nothing happens, enable JavaScript.", "You will be redirected shortly.", "This may take a few seconds."))
    out += _every(("Please", "", "We need you to"), ("verify", "confirm", "prove", "check"), ("that you are", "you are"), ("human.", "not a robot.", "a human and not a robot."), step=2)
    out += _every(("Complete", "Solve", "Please complete"), ("the security check", "the challenge", "the CAPTCHA"), ("to continue.", "to access this page.", "to proceed."), step=2)
    out += _every("Checking", ("your browser", "your connection", "if the site connection is secure"), ("before accessing the site.", "before opening the page.", "."), ("", "Ray ID: 1234567890.", "This process is automatic."))
    out += ["Unusual traffic has been detected from your network.", "Too many requests from your address.", "DDoS protection is active.", "I'm not a robot", "Verifying you are human. This may take a few seconds."]
    for script in ("JavaScript", "Cookies"):
        out += [f"Bitte aktivieren Sie {script} in Ihrem Browser.", f"Veuillez activer {script} dans votre navigateur.", f"Active {script} en su navegador.", f"Abilita {script} nel tuo browser.", f"Ative {script} no seu navegador.", f"Schakel {script} in uw browser in.", f"Włącz {script} w przeglądarce.", f"{script} ist erforderlich.", f"{script} est requis.", f"Se requiere {script}."]
    out += [
        "Seite nicht gefunden.", "Die Seite existiert nicht.", "Diese Seite konnte nicht gefunden werden.", "Zurück zur Startseite", "Zugriff verweigert.", "Bitte melden Sie sich an.", "Page non trouvée.", "Page introuvable.", "Cette page n'existe pas.",
        "Retour à l'accueil", "Accès refusé.", "Veuillez vous connecter.", "Página no encontrada.", "La página no existe.", "Volver al inicio", "Acceso denegado.", "Pagina non trovata.", "La pagina non esiste.", "Torna alla home", "Accesso negato.",
        "Página não encontrada.", "Voltar ao início", "Acesso negado.", "Pagina niet gevonden.", "Toegang geweigerd.", "Nie znaleziono strony.", "Odmowa dostępu.", "Sidan hittades inte.", "Siden blev ikke fundet.", "Страница не найдена.", "Доступ запрещён.",
        "Bestätigen Sie, dass Sie kein Roboter sind.", "Confirmez que vous n'êtes pas un robot.", "Confirme que no es un robot.", "Service nicht verfügbar.", "Service indisponible.", "Ein Fehler ist aufgetreten.", "Une erreur est survenue.", "Se ha producido un error.",
        "Skip to main content", "Skip to content", "Home | About | Contact", "Accept all cookies", "Cookie settings", "Privacy policy | Terms of use", "Back to top", "All rights reserved.",
    ]
    return out


# The well-known filler passage, and short filler in common use.
LOREM = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Lorem ipsum", "Lorem Ipsum:", "lorem ipsum dolor sit amet",
)
SHORT = ("sample", "dummy", "placeholder", "example", "filler", "test")
KEYS = ("asdf", "qwerty", "blah", "foo bar", "xxx", "test", "text", "abc", "lorem")
# End of fixed values.


def filler() -> list[str]:
    """Filler and sample text."""
    out = [*LOREM, "The quick brown fox jumps over the lazy dog.", "Blindtext", "Texte de remplissage.", "Texto de relleno.", "Testo segnaposto.", "Texto de exemplo.", "Beispieltext.", "Platzhaltertext."]
    for kind in SHORT:
        for noun in ("text", "paragraph", "heading", "content", "copy", "title"):
            one = f"{kind} {noun}"
            out += [f"{one.capitalize()}.", f"{one.capitalize()}. {one.capitalize()}. {one.capitalize()}.", f"This is {one}.", f"{one} {one}"]
    out += _every(("Your", "Add your", "Insert your", "Put your", "Add", "Insert"), ("text", "content", "title", "heading", "paragraph", "description"), ("here.", "goes here.", "will go here.", "."), step=2)
    out += _every(("Text", "Content", "Table", "Figure", "More"), ("to follow.", "follows.", "coming soon.", "goes here."))
    for a, b in zip(KEYS, (*KEYS[1:], KEYS[0]), strict=True):
        out += [f"{a} {a} {a}", f"{a} {a} {a} {b} {b}", f"{a} {b} {a} {b}"]
    return out


def shells() -> list[str]:
    """Instructions to authors, empty forms and tables, and failed fillings."""
    out = ["Click or tap here to enter text.", "Click here to enter text.", "Click or tap to enter a date.", "Click here to enter a date.", "Choose an item.", "Select a value.", "Enter any content that you want to repeat.", "Type here.", "To be completed.", "To be confirmed.", "To be added."]
    part = ("text", "paragraph", "section", "sentence", "table", "box", "note", "instruction", "guidance", "comment")
    out += _every(("Replace", "Overwrite"), ("this", "the"), part, ("with your own text.", "with the final text.", "with the results.", "with a short description."), step=5)
    out += _every(("Delete", "Remove"), ("this", "the", "all"), part, ("before submission.", "before finalising.", "when done.", "from the final version.", "before the document is published."), step=7)
    task = ("describe", "summarise", "state", "list", "explain", "add", "insert", "complete", "give")
    what = ("the methods", "the main results", "the objectives", "the study population", "the conclusions", "a short description", "the title", "the key points", "the limitations", "the summary")
    out += _every(("Author:", "Note to author:", "Instruction:", "Guidance:", "TODO:", "Writer's note:", "[Instruction]"), task, what, ("here.", "in this section.", "in two or three sentences.", "and remove this note.", "in this box."), step=23)
    out += [f"{t.capitalize()} {w} {where}" for t, w, where in list(product((*task, "type", "enter"), what, ("here.", "in this section.", "in this box.", "below.")))[::5]]
    for blank in ("____", "________", "........", "......", "[    ]", "☐"):
        out += [f"{name}: {blank}" for name in ("Name", "Date", "Signature", "Title", "Site", "Address", "Place")] + [f"Name: {blank} Date: {blank} Signature: {blank}", f"{blank} | {blank} | {blank}"]
    out += ["DD/MM/YYYY", "dd/mm/yyyy", "DD-MMM-YYYY", "YYYY-MM-DD", "MM/DD/YYYY", "__/__/____", "hh:mm", "Date: DD/MM/YYYY"]
    mask = ("XX", "XXX", "XX.X", "xx", "xx.x", "xx.xx", "XXXX", "X.XX", "##", "??", "nn.n")
    for m in mask:
        out += [m, f"N={m}", f"n={m}", f"{m}%", f"p={m}", f"{m} ({m})", f"{m} ({m}%)", f"Mean (SD) | {m} ({m}) | {m} ({m})", f"n (%) | {m} ({m}%) | {m} ({m}%)", f"Median | {m} | {m}", f"in {m} of {m} patients", f"{m} to {m}"]
    labels = ("Name", "Date", "Title", "Site", "Patients", "Subjects", "Dose", "Country", "Version", "Owner", "Total", "Visit", "Author", "Status", "Sites", "Duration")
    for gap in ("TBD", "TBC", "TBA", "tbd", "TODO", "TK", "[●]", "[•]", "[*]", "[ ]", "[...]", "[…]", "<tbd>", "<tbc>", "<insert>", "<blank>", "(to be added)", "___", "???"):
        out += [gap, f"Result: {gap}.", f"Title: {gap}", f"{gap}. {gap}.", f"Date: {gap}; place: {gap}", f"at week {gap} in the {gap} group", f"{gap} | {gap} | {gap}"]
        out += [f"{a}: {gap}. {b}: {gap}." for a, b in zip(labels, labels[3:], strict=False)]
    for failed in ("undefined", "null", "NaN", "None", "[object Object]", "nan", "Infinity", "%s", "%d", "{0}", "$1", "(null)"):
        out += [failed, f"Name: {failed}", f"Dear {failed},", f"Hello {failed},", f"{failed}: {failed}", f"mean {failed} mmHg", f"({failed}%)", f"{failed} of {failed}", f"Date: {failed}; total: {failed}", f"at {failed} and {failed}", f"was {failed} points"]
    for cell in ("#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!", "#NUM!"):
        out += [cell, f"{cell} | {cell}", f"Total | {cell}", f"{cell} %"]
    out += ["| | |", "| | | |", "|  |  |  |", "... | ... | ...", "- | - | -", "Table: [insert table here]", "Figure: [insert figure here]", "[image]", "[Table 1 here]", "[citation needed]", "[ref]", "Error! Reference source not found.", "Error! Bookmark not defined."]
    return out


NOTICES, FILLER, SHELLS = notices(), filler(), shells()

#: Ways of marking a slot; {} is the field.
SLOT_MARKS = [
    "{{{{{}}}}}", "{{{{ {} }}}}", "{{{}}}", "${{{}}}", "{{% {} %}}", "<<{}>>", "&lt;{}&gt;", "%%{}%%", "@@{}@@", "§§{}§§", "#{}#", "__{}__", "%{}%", "~{}~", "[{}]", "<{}>",
    "[INSERT {}]", "[Enter {}]", "[{} TO BE ADDED]", "<{} here>", "<enter {}>", "[insert {} here]", "<?{}?>", "[[{}]]", "<%= {} %>", "«{}»",
    "<Platzhalter: {}>", "<marcador: {}>", "<à compléter: {}>", "[bitte {} ergänzen]", "<inserire {}>",
]

#: Names of fields; capitals and spaces are varied.
SLOT_FIELDS = [
    "name", "first_name", "user_name", "title", "date", "address", "company", "country", "city", "email", "phone", "site", "study_title", "report_id", "visit_date", "dose", "drug_name",
    # the title page of a study report as guidelines list it
    "sponsor", "investigator", "indication", "protocol_no", "phase", "population", "primary_endpoint", "test_drug", "start_date", "end_date", "signatory",
    "arm_label", "p_value", "mean_change", "n_patients", "value", "reference", "author", "version", "page.title", "section", "year", "unit", "total", "user.id", "item.price",
]

#: What leads to a slot.
SLOT_LEADS = ["See {}.", "Contact {}.", "Date {}.", "Prepared for {}.", "Dear {},", "{}", "the {} of", "in {} and"]


def slots() -> list[str]:
    """Every mark with every field, in the usual spellings and after varying leads."""
    out = []
    for i, mark in enumerate(SLOT_MARKS):
        for j, field in enumerate(SLOT_FIELDS):
            forms = {field, field.upper(), field.replace("_", " ").replace(".", " ")}
            for k, form in enumerate(sorted(forms)):
                out.append(SLOT_LEADS[(i + j + k) % len(SLOT_LEADS)].format(mark.format(form)))
    return out
