"""Template residue, filler and notices in place of content, found by one multi-pattern automaton."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Wording of notices, in lower case with single blanks.
NOTICES = [
    "404 not found", "error 404", "fehler 404", "erreur 404", "page not found", "the page you are looking for", "has moved or no longer exists",
    "seite wurde nicht gefunden", "die angeforderte seite", "page introuvable", "la page demandée n'est pas disponible", "la page demandée n'existe",
    "could not be located on this server", "the requested decision could not be", "the requested url", "was not found on this server",
    "error 500", "error 502", "error 503", "error 504", "internal server error", "erreur interne du serveur", "interner serverfehler", "bad gateway",
    "service unavailable", "service temporarily unavailable", "service indisponible", "dienst nicht verfügbar", "gateway timeout", "gateway time-out",
    "the upstream server did not answer", "could not connect to database", "fatal error:", "uncaught exception", "stack trace:", "traceback (most recent call last)",
    "nullpointerexception", "java.lang.", "an unexpected error has occurred", "something went wrong", "une erreur est survenue", "es ist ein fehler aufgetreten",
    "access denied", "accès refusé", "zugriff verweigert", "403 forbidden", "401 unauthorized", "you do not have permission", "vous n'êtes pas autorisé", "keine berechtigung",
    "your session has expired", "please sign in again", "please log in again", "sitzung abgelaufen", "ihre sitzung ist abgelaufen", "melden sie sich erneut an",
    "votre session a expiré", "session expirée", "veuillez vous reconnecter", "please sign in to continue", "please log in to continue",
    "down for scheduled maintenance", "down for maintenance", "under maintenance", "site en maintenance", "wartungsarbeiten", "maintenance en cours",
    "too many requests", "your access has been throttled", "rate limit exceeded", "trop de requêtes", "zu viele anfragen", "please try again in a few minutes",
    "checking that you are not a robot", "verify you are human", "checking your browser", "please complete the captcha",
    "need to enable javascript", "enable javascript", "javascript is required", "javascript is disabled", "javascript required", "requires javascript", "activer javascript",
    "aktivieren sie javascript", "bitte aktivieren sie javascript", "veuillez activer javascript", "please enable javascript", "please enable scripts", "bitte aktivieren sie cookies", "veuillez activer les cookies", "javascript aktivieren", "javascript est désactivé", "does not support scripts", "enable scripts", "scripts are disabled",
    # HTTP statuses and server errors
    "400 bad request", "error 400", "error 401", "error 403", "405 method not allowed", "408 request timeout", "410 gone", "429 too many requests", "500 internal server error", "502 bad gateway", "502 proxy error", "503 service", "504 gateway", "proxy error", "request timed out", "connection timed out", "connection refused", "connection reset",
    "server error", "unexpected error", "unknown error", "application error", "database error", "runtime error", "syntax error near", "undefined index", "undefined variable", "segmentation fault", "core dumped", "sqlstate", "ora-0", "odbc", "exception in thread", "nullreferenceexception", "an error occurred", "an error has occurred", "error while processing", "error processing your request",
    "invalid request", "bad request", "failed to load", "unable to load", "could not be loaded", "cannot be displayed", "can't be displayed", "cannot be reached", "can't be reached", "temporarily unavailable", "currently unavailable", "no longer available", "is not available in your", "has been removed or", "does not exist or", "page does not exist", "page you requested", "we can't find", "we couldn't find", "we could not find",
    # sessions and rights
    "log in to continue", "log in to view", "login to view", "sign in to view", "login required", "log in again", "sign in again", "session timed out", "session has timed out", "login has expired", "login has timed out", "token has expired", "subscribe to continue", "subscribers only", "create an account to", "you must be logged in", "you need to be logged in", "you are not authorized", "you are not allowed", "not authorised to view", "not authorized to view", "permission denied",
    # maintenance, limits and checks
    "back shortly", "we'll be back", "site is being upgraded", "undergoing maintenance", "scheduled maintenance", "website is offline", "site is offline", "access has been blocked", "access has been limited", "request has been blocked", "requests have been blocked", "unusual traffic", "are you a robot", "i'm not a robot", "one more step", "ddos protection", "ray id", "please wait while", "loading, please wait", "loading please wait", "redirecting you",
    # scripts
    "turn on javascript", "javascript must be enabled", "javascript to be enabled", "needs javascript", "without javascript", "javascript support", "javascript is not enabled", "scripts are blocked", "browser is not supported", "browser is out of date", "update your browser", "unsupported browser",
    # German
    "seite nicht gefunden", "seite existiert nicht", "seite ist nicht mehr verfügbar", "inhalt ist nicht mehr verfügbar", "nicht mehr verfügbar", "vorübergehend nicht verfügbar", "derzeit nicht verfügbar", "zurzeit nicht erreichbar", "derzeit nicht erreichbar", "unerwarteter fehler", "interner fehler", "ein fehler aufgetreten", "fehler beim laden", "konnte nicht geladen werden", "zeitüberschreitung", "verbindung fehlgeschlagen",
    "bitte loggen sie sich ein", "bitte melden sie sich an", "melden sie sich an, um", "anmeldung erforderlich", "sie sind nicht berechtigt", "keine zugriffsrechte", "javascript deaktiviert", "benötigt javascript", "javascript wird benötigt", "javascript muss aktiviert", "browser wird nicht unterstützt", "zu viele zugriffe",
    # French
    "page non trouvée", "n'existe plus", "n'est plus disponible", "momentanément indisponible", "temporairement indisponible", "actuellement indisponible", "une erreur s'est produite", "erreur inattendue", "erreur serveur", "erreur de connexion", "impossible de charger", "impossible d'afficher", "délai d'attente dépassé",
    "vous devez vous connecter", "veuillez vous connecter", "connexion requise", "vous n'avez pas les droits", "accès interdit", "nécessite javascript", "javascript est requis", "javascript doit être activé", "navigateur n'est pas pris en charge", "chargement en cours",
    "blocked because cookies are disabled", "cookies are disabled", "enable cookies", "turn on cookies", "activer les cookies", "cookies aktivieren", "does not support javascript",
]
#: How a notice speaks to its reader or of itself; behind such a head, at the start of its sentence, a wording of a notice counts whatever its share of the sentence.
HEAD = re.compile(
    r"(?i)(?:(?:we(?:'|’)?re sorry|sorry|oops|désolé|entschuldigung|leider|error|warning|hinweis|attention)\b[\s,!:–-]*(?:but |mais |aber )?)?"
    r"(?:your|this|ihr|ihre|dieser?|dieses|votre|cet?|cette)\s+(?:current |web ?)?(?:browser|page|site|website|content|document|app|application|portal|service|seite|inhalt|dokument|anwendung|navigateur|contenu)\b(?:\s+\S+){0,3}\s*"
)
# Wording of filler, likewise.
FILLERS = [
    "body copy goes here", "your content goes here", "your text here", "text goes here", "content goes here", "replace before publication", "test paragraph, please ignore", "please ignore",
    "this paragraph is a dummy", "dummy text", "placeholder text", "sample text sample text", "this is a sample", "texte factice", "à remplacer par", "texte de remplissage", "hier steht ein blindtext", "blindtext",
    "bitte später ersetzen", "platzhaltertext", "asdf asdf", "jkl jkl", "test test", "insert text here", "fill in text", "add text here", "enter text here", "type your text", "write your text", "todo: write", "todo: add", "to be written", "text to follow", "content to follow", "filler text", "platzhalter für", "text folgt", "beispieltext", "mustertext", "texte à venir", "texte d'exemple", "contenu à venir", "n/a n/a", "aaaa aaaa", "blah blah", "xxx xxx", "qwerty qwerty", "bla bla bla", "foo bar baz", "coming soon", "under construction",
]
# Words of the customary Latin filler.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad
minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit
esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
# Words that begin or end a placeholder in square brackets.
BRACKET_HEADS = [
    "insert", "enter", "fill in", "specify", "to be completed", "to be inserted", "to be confirmed", "to be determined", "to be added", "to be filled", "tbd", "tbc", "todo", "placeholder", "name of", "name des", "name der", "nom du", "nom de",
    "date of", "à compléter", "a compléter", "à remplir", "à insérer",
]
BRACKET_TAILS = ["here", "eintragen", "einfügen", "ausfüllen", "einsetzen", "ergänzen", "à compléter", "à insérer"]
# What every match of the placeholder pattern or BLANK, but for brackets, holds a part of, in lower case with single blanks; the automaton finds these, the patterns then decide.
OPENERS = ["{", "<", "&lt;", "[[", "@@", "##", "__", "xx.xx", "xx/xx", "xx-xx", "#ref", "#n/a", "#value", "#div/0", "#name?", "#null", "[object", "......", "………", "%"]

_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ.\-]{0,60}"


@dataclass(frozen=True)
class Wordings:
    """What counts as residue: phrases in lower case with single blanks; latin: the words of Latin filler."""

    notices: tuple[str, ...] = tuple(NOTICES)
    fillers: tuple[str, ...] = tuple(FILLERS)
    latin: tuple[str, ...] = tuple(LATIN)
    bracket_heads: tuple[str, ...] = tuple(BRACKET_HEADS)
    bracket_tails: tuple[str, ...] = tuple(BRACKET_TAILS)

    @staticmethod
    def more(notices: Iterable[str] = (), fillers: Iterable[str] = (), bracket_heads: Iterable[str] = (), bracket_tails: Iterable[str] = ()) -> Wordings:
        """The default ones and more, in any case and spacing."""
        flat = lambda old, new: (*old, *dict.fromkeys(" ".join(x.split()).lower() for x in new if x.strip()))
        return Wordings(flat(NOTICES, notices), flat(FILLERS, fillers), tuple(LATIN), flat(BRACKET_HEADS, bracket_heads), flat(BRACKET_TAILS, bracket_tails))


@lru_cache(maxsize=8)
def placeholder(wordings: Wordings) -> re.Pattern:
    any_of = lambda words: "|".join(map(re.escape, words)).replace("\\ ", " ")
    return re.compile("|".join([
        r"\{\{[^{}\n]{1,80}\}\}", r"[$#]\{[^{}\n]{1,80}\}", r"\{%[^{}\n]{1,120}%\}", rf"(?<![{{$#\w])\{{\s*{_NAME}\s*\}}(?!\}})",
        r"<%[^<>\n]{1,120}%>", r"\[\[[^\[\]\n]{1,80}\]\]", rf"<<\s*{_NAME}\s*>>", r"<[A-Z][A-Z0-9_]{2,60}>", rf"&lt;\s*{_NAME}\s*&gt;",
        r"%[A-Z][A-Z0-9_]{2,60}%", rf"%\({_NAME}\)[sdif]", r"(?P<mark>@@|##|__)[A-Za-z][A-Za-z0-9_.\-]*?(?P=mark)",
        r"\bXX(?P<sep>[./-])XX(?P=sep)(?:20|19|XX)?XX\b", r"#(?:REF!|N/A|VALUE!|DIV/0!|NAME\?|NULL!)", r"\[object [A-Z]\w+\]",
        *([rf"(?i:\[\s*(?:{any_of(wordings.bracket_heads)})\b[^\[\]\n]{{0,80}}\])"] if wordings.bracket_heads else []),
        *([rf"(?i:\[[^\[\]\n]{{1,80}}\b(?:{any_of(wordings.bracket_tails)})\s*\])"] if wordings.bracket_tails else []),
    ]))


#: Runs of underscores or dots to be filled in; after a capital and a full stop they mark a redacted name.
BLANK = re.compile(r"(?<![A-Za-zÀ-ÿ_])(?<![A-Z]\.)_{2,}|(?<!\.)\.{6,}(?!\.)|…{3,}")
VOIDS = ["null", "undefined", "NaN", "None", "NULL"]
_VOID = rf"(?:{'|'.join(VOIDS)})"
_LABEL = r"(?:\[\d+\]|\(\d+\)|\d+[.)]|¶\s*\d+|>)"
#: Printed missing values that fill a slot: a whole line, a party's side, or the value after a label or date word.
MISSING = re.compile(rf"(?m)^[ \t]*(?:{_LABEL}\s*)?{_VOID}[ \t]*$|^[ \t]*{_VOID}[ \t]+(?:v\.?|vs\.?|c/|\./\.)(?=\s)|(?<=\s)(?:v\.?|vs\.?|c/|\./\.)[ \t]+{_VOID}[ \t]*$|(?::|\b(?:on|le|am|vom|du))[ \t]+{_VOID}[ \t]*$|\bNaN\b")
_QUOTES = "\"“”„«»‚‘’‹›"
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=8)
def automaton(wordings: Wordings):
    """The automaton of all wordings and openers, built once a process."""
    import ahocorasick

    brackets = [*(o + w for w in wordings.bracket_heads for o in ("[", "[ ")), *(w + c for w in wordings.bracket_tails for c in ("]", " ]"))]
    a = ahocorasick.Automaton()
    for kind, words in (("opener", [*OPENERS, *brackets]), ("latin", [w for w in wordings.latin if len(w) > 5]), ("filler", wordings.fillers), ("notice", wordings.notices)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] stands directly between quotation marks."""
    before, after = text[:start].rstrip(" "), text[end : end + 2].lstrip(" ")
    return before[-1:] in _QUOTES and before != "" and after[:1] in _QUOTES and after != ""


def _within_quotes(line: str, start: int, end: int) -> bool:
    """Whether line[start:end] lies inside one short quotation of its line."""
    left = max(line.rfind(q, 0, start) for q in '"“„«')
    if left < 0:
        return False
    closer = {'"': '"', "“": "”", "„": "“”", "«": "»"}[line[left]]
    if line[left] == '"' and line.count('"', 0, start) % 2 == 0:
        return False
    if line[left] != '"' and any(c in line[left + 1 : start] for c in closer):
        return False
    right = min((p for c in closer if (p := line.find(c, end)) >= 0), default=-1)
    return right >= 0 and right - left <= 240


class Residue:
    """What one text holds; found lists (kind, start, end) in offsets of the text."""

    def __init__(self, text: str, least_cover: float = 0.5, least_words: int = 4, wordings: Wordings = Wordings()):
        self.text, self.found = text, []
        flat = f" {' '.join(text.split()).lower()} "
        hits = list(automaton(wordings).iter(flat))
        kinds = {kind for _, (kind, _) in hits}
        if "opener" in kinds:
            self._slots((placeholder(wordings), "placeholder"), (BLANK, "blank"))
        if any(w in text for w in VOIDS):
            self._slots((MISSING, "missing"))
        if kinds & {"notice", "filler"}:
            self._wordings(hits, least_cover)
        if "latin" in kinds:
            self._latin(least_cover, least_words, set(wordings.latin))

    def _slots(self, *patterns) -> None:
        for pattern, kind in patterns:
            for m in pattern.finditer(self.text):
                if not _quoted(self.text, *m.span()):
                    self.found.append((kind, *m.span()))

    def _wordings(self, hits, least_cover: float) -> None:
        """Wordings that fill most of their sentence, begin it if long, or follow a notice's HEAD; quoted ones are evidence, not residue."""
        tokens = [m.span() for m in re.finditer(r"\S+", self.text)]
        starts, at = [], 0
        breaks = [0]  # tokens that begin a sentence or line
        for k, (a, b) in enumerate(tokens):
            starts.append(at)
            at += len(self.text[a:b].lower()) + 1
            if k and ("\n" in self.text[tokens[k - 1][1] : a] or self.text[tokens[k - 1][1] - 1] in ".!?:;"):
                breaks.append(k)
        breaks.append(len(tokens))
        by_sentence: dict[tuple[int, int], list] = {}
        for end, (kind, size) in hits:
            if kind not in ("notice", "filler"):
                continue
            first, last = bisect_right(starts, end - size) - 1, bisect_right(starts, end - 1) - 1
            span = tokens[first][0] + end - size - starts[first], tokens[last][0] + end - starts[last]
            p, q = self.text.rfind("\n", 0, span[0]) + 1, self.text.find("\n", span[1])
            line = self.text[p : q if q >= 0 else None]
            if _within_quotes(line, span[0] - p, span[1] - p):
                continue
            s = breaks[bisect_right(breaks, first) - 1]
            e = breaks[bisect_right(breaks, last)] if last < len(tokens) - 1 or breaks[-1] > last else len(tokens)
            by_sentence.setdefault((s, e), []).append((kind, first, last, span))
        for (s, e), parts in by_sentence.items():
            while s < e - 1 and re.fullmatch(rf"{_LABEL}|¶|\d+", self.text[slice(*tokens[s])]):
                s += 1
            covered = set()
            for _, a, b, _ in parts:
                covered |= set(range(a, b + 1))
            size = lambda ks: sum(tokens[k][1] - tokens[k][0] for k in ks)
            begins = any(a == s and span[1] - span[0] >= 20 for _, a, _, span in parts)
            told = any(kind == "notice" and HEAD.fullmatch(self.text, tokens[s][0], span[0]) for kind, _, _, span in parts)
            if begins or told or size(covered) >= least_cover * size(range(s, e)):
                self.found += [(kind, *span) for kind, _, _, span in parts]

    def _latin(self, least_cover: float, least_words: int, known: set[str]) -> None:
        for m in re.finditer(r"[^.!?\n]+", self.text):
            words = [w.lower() for w in _WORD.findall(m[0])]
            if len(words) >= least_words and sum(w in known for w in words) >= max(least_cover, 0.6) * len(words):
                self.found.append(("filler", *m.span()))


def find_residue(df: DataFrame, id_col: str, text_col: str, least_cover: float = 0.5, wordings: Wordings = Wordings()) -> DataFrame:
    """(id, kinds, n_found, covered, char_start) of the texts that hold residue where content should stand.

    One automaton over all wordings and openers passes each whole text once; only texts with hits
    are looked at more closely. Placeholders, blanks and printed missing values count where they
    fill a slot. Notices and filler count where they cover least_cover of their sentence or line,
    or begin it, notices also where their sentence begins with HEAD ("Your browser ..."); measuring against the slot and not the whole text also finds texts that hold
    residue only in part. Wording between quotation marks is evidence and doesn't count, nor do
    redaction marks and editorial brackets. covered is the share of the text that is residue.
    wordings: other phrases, or more of them (Wordings.more). Null and empty texts have none; repeated texts come out repeatedly; map-only.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch[id_col], batch[text_col]):
                if text and (found := Residue(text, least_cover, wordings=wordings).found):
                    length = len(set().union(*(range(a, b) for _, a, b in found)))
                    rows.append((key, ",".join(sorted({k for k, _, _ in found})), len(found), length / len(text), min(a for _, a, _ in found)))
            yield pd.DataFrame(rows, columns=[id_col, "kinds", "n_found", "covered", "char_start"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, kinds string, n_found int, covered double, char_start int")
