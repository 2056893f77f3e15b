import pytest

from terrasieve.llm.residue import BRACKET_HEADS, BRACKET_TAILS, VOIDS, Residue, Wordings, find_residue

HELD = [
    "Rulings\n\n{{ court.name }} v Smith", "paid ${amount} crowns", "the #{party_no} appealed", "{decision.text} c/ P.", "<<judge-Id>> ./. X.", "v <COURT_FULL>", "by <%= hearing-name %> on", "{% block judge.City %}", "[[docket.id]] v A.",
    "&lt;judge-Title&gt; v B.", "%COURT_ID% v C.", "%(reporter.Full)s v D.", "@@APPLICANT_FULL@@ said", "##JUDGE_DATE## said", "__COURT_NO__ said", "the sum of [INSERT AMOUNT] crowns", "[TO BE COMPLETED] c/ L.", "[à compléter : court] v X",
    "[Name des Klägers eintragen] v X", "[type judge here] v X", "Given under my hand this ____ day of ________ 20__.", "Nordhavel, den __.__.20__", "on XX.XX.20XX the", "AP-1\nnull v null\nHeld", "undefined c/ null", "#REF! v #N/A", "[object Object] v NaN", "text\nnull\ntext",
    "(3) Lorem ipsum dolor sit amet consectetur elit.", "Fugiat aliqua velit sint labore.\nOrder", "¶ 2 Test paragraph, please ignore.", "xxx xxx xxx xxx", "Hier steht ein Blindtext. Bitte später ersetzen.", "4. Sample text sample text sample text.",
    "404 Not Found", "[1] Access denied\nYou do not have permission to view this document.", "Home | Help\nGateway timeout. The upstream server did not answer.", "Sitzung abgelaufen. Bitte melden Sie sich erneut an.", "Erreur interne du serveur.", "Error 503 - Service temporarily unavailable",
    "java.lang.NullPointerException\n\tat app.render.View.load(View.java:1)", "Bitte aktivieren Sie JavaScript, um die Entscheidung anzuzeigen.", "3. Veuillez activer JavaScript pour afficher cette page.", "You  need to\nenable JavaScript to run this app.", "We are down for scheduled maintenance.",
    "The appeal fails. Please enable scripts in your browser and reload.", "Warning: could not connect to database in /var/www/view.php on line 14", "Checking that you are not a robot ...",
]
NOT_HELD = [
    None, "", " ", "[REDACTED] v [anonymisiert]", "A.________ gave evidence. A.________ v N.N.", "[...] and *** and ████ [sic] (name withheld) [nom occulté]", 'a token such as "{{customer}}" which the vendor had to replace.', 'left the field "[Name of Tenant]" blank',
    'la mention "[nom du bailleur]", ce que X', "The printer's proof contained lorem ipsum text, a fact which L. raised only on appeal.", 'The error message "Your session has expired" appeared on the terminal.', 'shows the words "404 Not Found" at the time',
    "According to the log, the server returned status 503 for nine minutes on the last day.", "Whether the portal required JavaScript to be enabled is irrelevant to the question of service.", 'den Hinweis "Bitte aktivieren Sie JavaScript", was unstreitig ist.', 'the site answered "Access denied" on each attempt.',
    "The clause is null and void. The term remains undefined in law.", "see [2018] HCA 686 at [39]; the tenancy ordinance, 5 % of costs...", "None of the parties appeared. The session was adjourned. The server of the writ was heard.", "word " * 50_000,
]


@pytest.mark.parametrize("text", HELD)
def test_held(text):
    assert Residue(text).found


@pytest.mark.parametrize("text", NOT_HELD[1:])
def test_not_held(text):
    assert not Residue(text or "").found


def test_operator(spark):
    rows = list(enumerate([*HELD, *NOT_HELD, HELD[0]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as kinds")
    got = {r.doc_id for r in find_residue(df, "doc_id", "text").collect()}
    assert got == {*range(len(HELD)), len(HELD) + len(NOT_HELD)}
    assert find_residue(df.limit(0), "doc_id", "text").count() == 0
    whole = find_residue(spark.createDataFrame([(1, "404 Not Found")], "doc_id long, text string"), "doc_id", "text").first()
    assert whole.covered == 1.0 and whole.kinds == "notice"


TOLD = [
    "Your browser does not support scripts, so this document cannot be shown.", "2. Your browser does not support scripts, so this document cannot be shown.\nOrder: the appeal is dismissed.",
    "Startseite > Entscheidungen\nYour browser does not support scripts, so this document cannot be shown.", "Sorry, but this page requires JavaScript before any of the decisions of the court can be displayed.",
]
NOT_TOLD = [
    "The witness said that his browser does not support scripts, so that the document could not be served on him.", "The portal requires JavaScript, a fact which L. raised only on appeal before this court.",
    'The screen read "Your browser does not support scripts, so this document cannot be shown." throughout.', "This site was under construction when the claimant bought the parcel from the former owner.",
]


@pytest.mark.parametrize("text", TOLD)
def test_notice_of_which_the_wording_is_the_smaller_part(text):
    assert {k for k, _, _ in Residue(text).found} == {"notice"}


@pytest.mark.parametrize("text", NOT_TOLD)
def test_report_of_a_notice(text):
    assert not Residue(text).found


ALONE = [
    "{{ a }} b", "${a} b", "#{a} b", "{% a %} b", "{a} b", "<% a %> b", "[[a]] b", "<<a>> b", "<AB_C> d", "&lt; a &gt; b", "%ABC% d", "%(a)s b", "@@a@@ b", "##a## b", "__a__ b", "on XX.XX.20XX the", "on XX/XX/XXXX the", "on XX-XX-20XX the", "on XX-XX-19XX the",
    *(f"a {e} b" for e in ("#REF!", "#N/A", "#VALUE!", "#DIV/0!", "#NAME?", "#NULL!")), "a [object Map] b", *(f"a [{w} b] c" for w in BRACKET_HEADS), *(f"a [  {w.upper()}] c" for w in BRACKET_HEADS), *(f"a [b {w}] c" for w in BRACKET_TAILS), *(f"a [b-{w}\t] c" for w in BRACKET_TAILS),
    "a ____ b", "a ...... b", "a ……… b", *(f"a\n{v}\nb" for v in VOIDS), *(f"a\n{x}{v}\nb" for v in VOIDS for x in ("[3]", "(3)", "3.", "3)", "¶ 3 ", ">")), *(f"{v} {w} b" for v in VOIDS for w in ("v", "v.", "vs", "vs.", "c/", "./.")), *(f"b {w} {v}" for v in VOIDS for w in ("v", "v.", "vs", "vs.", "c/", "./.")),
    *(f"{w} {v}" for v in VOIDS for w in ("Judge:", "on", "le", "am", "vom", "du")), "a sum of NaN.", "a sum of (NaN), b",
]


@pytest.mark.parametrize("text", ALONE)
def test_sole_residue_passes_the_gate(text):
    assert Residue(text).found


def test_wordings_are_a_parameter(spark):
    text = "1. Halaman tidak ditemukan.\n2. The appeal fails."
    assert not Residue(text).found
    more = Wordings.more(notices=["Halaman  tidak ditemukan"], bracket_heads=["isi"], fillers=["teks contoh"])
    assert {k for k, _, _ in Residue(text, wordings=more).found} == {"notice"} and Residue("a [isi nama] b", wordings=more).found and not Residue("a [isi nama] b").found
    df = spark.createDataFrame([(1, text), (2, "Teks contoh."), (3, "404 Not Found")], "doc_id long, text string")
    assert {r.doc_id for r in find_residue(df, "doc_id", "text", wordings=more).collect()} == {1, 2, 3}
    assert {r.doc_id for r in find_residue(df, "doc_id", "text", wordings=Wordings(notices=("halaman tidak ditemukan",), fillers=(), latin=(), bracket_heads=(), bracket_tails=())).collect()} == {1}
