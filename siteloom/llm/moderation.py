"""Abusive, hateful and sexual content: a lexicon trie met by Levenshtein automata, scored within context windows.

Every token is normalised (look-alike letters, digits for letters, stretched, spaced or masked spellings) and run against
the trie of all lexicon entries with a bounded edit distance. An entry is an anchor with a base weight; cues around it add
or take away: whom it addresses, which group it is about, and words of quotation, medicine, art, food or machinery.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.session import checkpointed

WINDOW = 14
THRESHOLD = 1.0
CATEGORIES = ("abusive", "hateful", "sexual")

# Words by category and weight in percent, in English, German, French and Spanish, without accents.
# A weight of 100 is a case by itself; lighter words need others, or someone addressed, in their window.
LEXICON = {
    ("sexual", 100): "fuck blowjob blowjobs porn porno pornos pornography tits pussy milf gangbang cumshot xxx orgy ficken fickt muschi titten sexcam follar polla baiser bukkake hentai",
    ("sexual", 60): "cock dick nipples nudes horny erections erection panties striptease moaned anal dildo fetish naughty geile geil nues nackten desnuda orgia sexfilme uncensored amateur explicites censura",
    ("sexual", 40): "naked nude sex sexo sexe sexy escort thrust undressed groaning laid oral cam cams hardcore nackte nackt nudity desnudas calientes chaudes adults busty strips bodies explicit toys swallowed licked camgirl",
    ("sexual", 20): "hot wet girls singles legs chicas filles frauen studentinnen gallery tonight rides dirty begged behind pics inside clips pills noche soir nacht escenas scenes deep vivo live",
    ("abusive", 100): "asshole assholes arsehole dickhead motherfucker scumbag dumbass bastard bastards cunt wanker twat prick halfwit moron morons imbecile imbeciles idiot idiots idiota idiote whore bitch retard cretin cretins abruti debile arschloch vollidiot missgeburt schlampe wichser penner hure schwachkopf schwachkopfen abschaum enculé connard connards salope gilipollas hijoputa pendejo batard subnormal cabron imbecil kill-yourself",
    ("abusive", 70): "shit shithead bullshit fresse maul verpiss merde gueule foutre puta mierda fucking bleed crever creve crevez muerete mueran drown kys fotze brain-dead braindead retarded brainless loser losers pig pigs your-ass to-hell go-die",
    ("abusive", 50): "ass jerk fool scum worthless useless pathetic trash crap disgusting smash teeth ditch dumb stirb sterben zahne infierno asco inutiles maldito estupido dreck drecksack sale casser partir figure stupid dummer dummes rotten ashamed pedazo degagez soporta haufen erbarmlicher bande spineless choke filthy clown waste oxygen monkey get-lost sleep-badly shut-up",
    ("abusive", 30): "die kill shut hate con dumm garbage go stick head geh halt halts cara vete callate hau ferme piece eat cow sack ugly miserable lying greedy crazy hell",
    ("hateful", 100): "subhuman untermenschen ungeziefer",
    ("hateful", 70): "vermin vermine parasite parasites parasit parasiten filth breed breeding minderwertig plaga hang inferior cockroaches",
    ("hateful", 50): "thieves rats animals disease betrays race rasse raza sinking breathing cleanse burn driven verjagt chasser echarlos kriminell criminal blood deport exterminate meritent merecen sobra pack smaller",
    ("hateful", 30): "brains boat houses fewer spreading natur dirty vote marry allowed deserve weg leave humans out miss blut vivre vivir children",
}
GROUPS = "refugees refugee foreigners foreigner migrants immigrants newcomers believers faith gens-la refugiados fluchtlinge auslander etrangers extranjeros musulmans natives tribe people folk leute gens gente"
# Words of contempt that name a group by themselves.
NAMED = frozenset("race rasse raza pack ungeziefer subhuman".split())
ADDRESSED = "you your yours yourself youre du dich dir dein deine ihr euch euer eure tu te ton tes toi vous votre t'es eres ti tus usted ustedes vosotros ich-hau"
# What turns a mention into a quotation or another sense: reporting, medicine, art, food, animals, machinery.
ASIDE = (
    "novel essay studies study propaganda called moderators moderator remove removes helpline victims quoted report reported article history museum-guide screening cancer health contraception sculptors marble figures carved painting "
    "kennel puppies puppy litter soup gravy pub cakes boots recipe process processes worker queue uploads jobs database replicas node parent restart drum bass coast bird species form recorded weight dictionary translation"
)
# Ordinary words and names that are spelled like an entry, without accents: never taken for a misspelling of it.
ORDINARY = frozenset(
    "fussy hussy pushy picken ticken nicken dicken flicken sicken zicken nickt tickt pickt flickt ficht bitten ritten sitten mitten kitten litten tritten dollar collar foliar pollo polls polly polka bolla colla holla pulla "
    "baisser baisers raiser braiser kaiser baser corno horno forno torno porto perno hornos tornos cornos pernos sonography phonography orography monography ripples tipples nodes dudes rudes nudges nukes nubes nudos "
    "thorny corny horns hornby election elections direction directions ejection ejections selection selections reactions rejection rejections detection detections evictions perfection perfections execution executions "
    "creations resection resections defection defections parties pantries pansies patties pasties loaned moated maned haughty naught teile weile seile keile heile meile feile zeile peile geige guile hackten packten backten knackten "
    "neckten nickten borgia uncentered uncensured armateur explicates implicites exploites censure mensura cesura baked raked faked waked caked named snaked nuked trust thrush addressed unaddressed redressed unstressed "
    "underused unblessed unpressed grounding profaning hardcover hardcode hardcoded nachte packte hackte backte neckte nickte knackte packt hackt backt neckt knackt pacientes clientes valientes salientes parientes dolientes "
    "calmantes chauves chaumes claudes adult adulte adultes adulto dusty rusty lusty musty gusty fusty bushy busby busts bursty strip stripe stripes straps strops trips bogies bodied bodices explicate explicitly explizit explizite "
    "wallowed locked kicked picked ticked nicked wicked linked liked lacked lucked flicked clicked slicked licker deckhead duckhead dastard dastards bustard bustards banker hanker canker tanker ranker wander walker anker wanken "
    "wankel wacker winker price brick trick crick erick pricy boron moran morton mormon mormons myron morin mourons idiom idioms idioma idiome where whole whose shore chore whorl birch pitch witch hitch batch botch butch mitch "
    "titch regard reward petard renard retards retarde retardo retarder cretan cretans creatin creton cretons debite defile decile schlappe stehlampe tischlampe renner kenner nenner tenner jenner penne pennen penned pinner penser "
    "bonnard galope salopp saloppe bayard bavard carbon cabros cabran presse tresse dresse kresse bresse fressen fresst gueuse gueules verriss verpass vermiss merge werde verde herde perde merle merke foudre poutre loutre "
    "outre fourre feutre boutre pierda muerda ducking bucking tucking mucking funking blend bleep blued bread breeds creed greed freed brewed bleeding breading breezing preceding breeching greve breve crete creme treve crepe crave "
    "crewe clever creer creez muerte fueran muevan brown crown grown frown drawn fetze regarded rewarded restarted stainless chainless leser closer closers looser loses laser lasers lower lowers lover lovers poser loner loners loger "
    "losen boser loyer loyers louer mirthless userless fuseless apathetic empathetic crash brash thrash discussing disguising digesting distrusting disrupting disputing stash slash tenth dutch stirn stirbt streben starben "
    "fahne sahne zahle zahme zaune invierno inferno estupendo wreck druck caser passer casier cassel casse cassee wasser nasser masser cesser causer classer casher caster chaser chausser parti partie partis partit partio martir patir "
    "parir figura figur figuren figured summer hummer nummer kummer drummer dimmer bummer dummies gotten roten routen ratten retten grotten motten rosten shamed unashamed pedalo soporte soportar soportan hafen laufen kaufen taufen "
    "saufen raufen hauen hausen harfen halfen hande bands lande rande wande banda bando bandy binde bunde bange barde brande bonde chose choker choked chokes flown blown taste paste haste caste baste wastes wasted weste wuste "
    "warte gaste kaste vaste money donkey verein vereine termin termine ermine hermine fermin vermik verpin fifth plaza playa placa plata plana plage llaga praga interior interiors inferir animal animales diseases betray betrags tasse "
    "kasse masse passe lasse gasse nasse basse fasse rosse trasse brasse raste russe risse raise linking singing winking inking sinning stinking slinking cleanser driver drives drive drivel riven versagt vertagt verzagt "
    "criminel bloody flood brood bloom blond depart depot deporte terminate determinate heritent perecen sobre cobra sombra sopra sobria sabra smeller breaching bleaching wreathing sheathing broaching preaching breasting "
    "duck luck suck buck muck puck tuck ruck funk born corn worn torn horn morn port pore pork norn hits bits pits kits sits fits wits nits lits tots tips tins ties tics tilts tints titus titos tito milk mild mile mill milo mils orgs orge orga porgy "
    "punt hunt runt bunt aunt cent cant curt cult count cuna junt sunt that swat teat trat twit twas pure sure cure lure here hare hire hurt hurl huge heure hurle jure dure mure shot ship shin spit slit suit skit whit chit shift shirt "
    "seit sait soit snit mail haul faul paul saul mall mahl maut gaul maus maui maud raul caul pupa pita pata ruta puts putt puja pura pula puna puma punta pauta juta figs digs wigs rigs jigs gigs pegs pugs pins pips pies pings cuent".split()
)

_LOOKALIKE = str.maketrans(
    "аеорсхуіѕјԁһոԛԝκοντρυαεικνЕТОРАНКХСВМ"[:37],
    "aeopcxyisjdhnqwkovtpuaeiknetopahkxcbm"[:37],
)
_LEET = str.maketrans("013457$@!|+", "oieastsaiit")
_INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤﻿]")
_TOKEN = re.compile(r"[\w$@*!|+][\w$@*'’!|+-]*")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_]){3,}\w(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？।])\s+|\n+|(?<=[.!?])[\"”»)]\s*")
_GARBLED = re.compile("[\u0080-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{2,}")
_RUN = re.compile(r"(.)\1{2,}")
_QUOTED = re.compile(r"[\"“„«‚‘']([^\"“”„«»‚‘]{2,80})[\"”“»‘]")


def _regained(m: re.Match) -> str:
    """What a run of characters was before its bytes were read as a Western encoding; the run itself if it was none."""
    raw = bytearray()
    for c in m.group():
        try:
            raw += c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252")
        except UnicodeError:
            return m.group()
    try:
        return raw.decode("utf-8")
    except UnicodeError:
        return m.group()


def plain(text: str) -> str:
    """Lower case without accents, invisible characters, look-alike letters and double-encoded characters."""
    if not text.isascii():
        text = _GARBLED.sub(_regained, text)
    text = _INVISIBLE.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LOOKALIKE)
    return text.lower().replace("ß", "ss").replace("’", "'")


@lru_cache(200_000)
def spelled(token: str) -> str:
    """A token with letters written as digits or signs undone, and stretched letters shortened to two."""
    token = token.strip("'-!|+")
    if any(c.isalpha() for c in token) and not token.isalpha():
        token = token.translate(_LEET)
    return _RUN.sub(r"\1\1", token)


def shortened(word: str, most: int) -> set[str]:
    """The word without up to `most` of its letters."""
    out = step = {word}
    for _ in range(most):
        step = {w[:i] + w[i + 1 :] for w in step for i in range(len(w))}
        out = out | step
    return out


class Trie:
    """All entries by letter; `near` walks it with the rows of a Levenshtein automaton, adjacent swaps counting once."""

    __slots__ = ("root", "shorter", "longest")

    def __init__(self, entries: dict[str, int]):
        self.root: dict = {}
        for word, at in entries.items():
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = at
        self.longest = max(map(len, entries), default=0)
        self.shorter = [frozenset(x for w in entries for x in shortened(w, most)) for most in range(3)]

    def near(self, token: str, most: int) -> list[tuple[int, int]]:
        """(entry, distance) of all entries within `most` edits. An asterisk in the token stands for any letter."""
        out: list[tuple[int, int]] = []
        if len(token) > self.longest + most:
            return out
        width = len(token) + 1
        # Texts within so many edits have a shortening in common, so most tokens need no walk.
        if most < 3 and "*" not in token and shortened(token, most).isdisjoint(self.shorter[most]):
            return out
        stack = [(self.root, "", list(range(width)), None)]
        while stack:
            node, last, row, above = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        out.append((child, row[-1]))
                    continue
                new = [row[0] + 1]
                for j in range(1, width):
                    t = token[j - 1]
                    cost = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (t != c and t != "*"))
                    if above is not None and j > 1 and t == last and token[j - 2] == c:
                        cost = min(cost, above[j - 2] + 1)
                    new.append(cost)
                if min(new) <= most:
                    stack.append((child, c, new, row))
        return out


def _entries() -> tuple[list[tuple[str, str, float]], dict[str, int]]:
    """(word, kind, weight) and the place of each word; kinds beside the categories: group, addressed, aside."""
    rows: dict[str, tuple[str, float]] = {}
    for kind, words in (("aside", ASIDE), ("addressed", ADDRESSED), ("group", GROUPS)):
        for w in words.split():
            rows[w] = (kind, 0.0)
    for (kind, weight), words in LEXICON.items():
        for w in words.split():
            w = plain(w)
            if w not in rows or rows[w][1] < weight / 100:
                rows[w] = (kind, weight / 100)
    table = [(w, k, x) for w, (k, x) in rows.items()]
    return table, {w: i for i, (w, _, _) in enumerate(table)}


TABLE, PLACE = _entries()
#: Entries of two words by their first word.
PAIRS: dict[str, dict[str, int]] = {}
for _word, _at in PLACE.items():
    if "-" in _word:
        _first, _, _second = _word.partition("-")
        PAIRS.setdefault(_first, {})[_second] = _at


#: From this weight on an entry is worth a misspelling. Lighter words add little and have many ordinary neighbours.
WORTH = 0.3
#: From this weight on so is an entry of four letters, for a swapped, changed or added letter; words of hate are longer.
WORTH_SHORT = 0.7


@lru_cache(1)
def trie() -> Trie:
    return Trie({w: i for i, (w, _, x) in enumerate(TABLE) if x >= WORTH})


def edits(token: str) -> int:
    """How many edits a token of this length may be away from an entry."""
    n = len(token)
    return 0 if n < 4 else 1 if n < 9 else 2


def _may_be(token: str, at: int) -> bool:
    """Whether a token may be a misspelling of an entry, by the lengths of both: short words have too many neighbours for
    every edit.
    """
    word, kind, weight = TABLE[at]
    if len(token) == 4:
        return len(word) == 4 and weight >= WORTH_SHORT and kind != "hateful"
    return len(word) >= 5 or (len(word) == 4 and len(token) == 5 and weight >= WORTH_SHORT and kind != "hateful")


class Matcher:
    """Entries of a token, exact or near, remembered per process.

    ORDINARY words ("where") are words of their own, not misspellings, whatever table is judged: what a token is depends on
    the token alone.
    """

    def __init__(self):
        self.known = {}

    def __call__(self, token: str) -> tuple[int, float] | None:
        """(entry, share of its weight)."""
        got = self.known.get(token, 0)
        if got == 0:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[token] = self.find(token)
        return got

    def find(self, token: str) -> tuple[int, float] | None:
        at = PLACE.get(token)
        if at is not None:
            return at, 1.0
        masked = token.count("*")
        word = spelled(token)
        at = PLACE.get(word)
        if at is None:
            at = PLACE.get(re.sub(r"(.)\1", r"\1", word)) if word != token or re.search(r"(.)\1", word) else None
        if at is not None and not masked:
            return at, 1.0
        if masked:
            inner = token.strip("*")
            if len(inner) > 2 and "*" not in inner and token[0] == token[-1]:
                return self(inner)  # set between asterisks for emphasis
            if len(token) - masked < 2 or len(token) < 4 or masked > len(token) - 2:
                return None
            hits = [(i, d) for i, d in trie().near(token, 0) if TABLE[i][2] >= 0.5]
            return (min(hits)[0], 0.9) if hits else None
        most = edits(word)
        if not most or not word.isalpha() or word in ORDINARY:
            return None
        hits = [(d, -TABLE[i][2], i) for i, d in trie().near(word, most) if d and _may_be(word, i)]
        if not hits:
            return None
        d, _, i = min(hits)
        return i, 0.8 if d == 1 else 0.7


def _unspaced(sentence: str) -> str:
    """Letters written apart are joined; where that hides several words, the entries inside are set apart again."""

    def join(m: re.Match) -> str:
        word = re.sub(r"[ .\-_]", "", m.group())
        out, at = [], 0
        rest = ""
        while at < len(word):
            for n in range(min(14, len(word) - at), 2, -1):
                i = PLACE.get(word[at : at + n])
                if i is not None and (TABLE[i][2] >= 0.5 and n > 3 or TABLE[i][1] in ("addressed", "group")):
                    out += [rest, word[at : at + n]]
                    rest, at = "", at + n
                    break
            else:
                rest += word[at]
                at += 1
        return " " + " ".join(w for w in [*out, rest] if w) + " "

    return _SPACED.sub(join, sentence)


def tokens_of(sentence: str) -> list[str]:
    return [t.strip("'-!|+") for t in _TOKEN.findall(_unspaced(sentence)) if t.strip("'-!|+")]


_NONE: dict[str, int] = {}


# People named by a word that no lexicon has: a capitalised word after a determiner, or a word that the sentence goes on to
# speak of as of several people. Determiners, verbs and phrases of four languages, and animals of which the same is said:
# fixed values.
_MANY = r"(?:the|these|those|all|every|les|ces|die|diese|alle|los|las|esos|estos)"
_DO = r"(?:are|were|should|must|do|don't|have|breed|belong|sind|sollen|mussen|gehoren|haben|sont|doivent|ont|son|deben|tienen)"
_NAMED_PEOPLE = re.compile(rf"\b(?i:{_MANY})\s+([A-ZÀ-ÖØ-Þ][\w'-]{{3,}})")
_SPOKEN_OF = re.compile(rf"(?:^|\b{_MANY} )([\w'-]{{4,}}) {_DO}\b|\b(?:of|to|on|from|against|the|all) ([\w'-]{{4,}}) (?:before they|because they|and they|they|nobody|all of them|every one of them)\b")
ANIMALS = frozenset(
    "ants aphids bats bears beetles bees birds bugs cats caterpillars cats chickens cows crows deer dogs ducks fish fleas flies foxes frogs geese goats horses insects locusts mice midges mites moles mosquitoes moths pests pigeons "
    "rabbits slugs snails spiders squirrels termites ticks wasps weeds wolves worms schnecken mause tauben wespen zecken lause motten insekten souris pigeons guepes tiques limaces insectes ratones palomas avispas garrapatas babosas insectos".split()
)


def people(text: str) -> frozenset[str]:
    """The words of a text (plain) that its capitals show as the name of a people."""
    return frozenset(plain(w) for w in _NAMED_PEOPLE.findall(_INVISIBLE.sub("", text)))


def spoken_of(tokens: list[str], match) -> bool:
    """Whether a sentence speaks of some word as of several people; entries of the lexicon and animals are none."""
    for a, b in _SPOKEN_OF.findall(" ".join(map(spelled, tokens))):
        word = a or b
        if word not in ANIMALS and match(word) is None:
            return True
    return False


#: What a window's context adds to the weights of its entries, before it is fitted (see `fit_context`): hate about a group and
#: without one; abuse with someone addressed, and light abuse (under 0.7) without; a disguised sexual word said to someone;
#: each word of another sense; an anchor within quotation marks.
PRIOR = {"group": 0.35, "no_group": -0.45, "addressed": 0.35, "light": -0.1, "disguised": 0.2, "aside": -0.8, "quoted": -0.6}


def windows(sentence: str, match: Matcher, named=frozenset) -> list[tuple[float, str, dict[str, float]]]:
    """(sum of weights, category, context) of the window around each anchor of a sentence, already plain.

    Within WINDOW tokens of an anchor each distinct entry of its category adds its weight. `named` gives the words that name
    a people; it is asked only where hate may be said.
    """
    found = []
    seconds: dict[str, int] = {}
    tokens = tokens_of(sentence)
    for i, t in enumerate(tokens):
        got = match(t)
        if got is not None:
            found.append((i, got[0], got[1]))
        word = spelled(t)
        if word in seconds:
            found.append((i, seconds[word], 1.0))
        seconds = PAIRS.get(word, _NONE)
    if not any(TABLE[e][2] >= 0.4 for _, e, _ in found):
        return []
    quoted = " ".join(_QUOTED.findall(sentence))
    out = []
    for i, e, share in found:
        word, kind, weight = TABLE[e]
        if kind not in CATEGORIES or weight < 0.4:
            continue
        around: dict[int, float] = {}
        for j, o, s in found:
            if abs(j - i) <= WINDOW:
                around[o] = max(around.get(o, 0), s)
        kinds = Counter(TABLE[o][1] for o in around)
        total = sum(TABLE[o][2] * s for o, s in around.items() if TABLE[o][1] == kind)
        context: dict[str, float] = {}
        if kind == "hateful":
            group = kinds["group"] or any(TABLE[o][0] in NAMED for o in around) or any(t in named() for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]) or spoken_of(tokens, match)
            context["group" if group else "no_group"] = 1
        elif kind == "abusive":
            if kinds["addressed"]:
                context["addressed"] = 1
            elif weight < 0.7:
                context["light"] = 1
        elif share < 1 and weight >= 1 and kinds["addressed"]:
            context["disguised"] = 1
        if kinds["aside"]:
            context["aside"] = kinds["aside"]
        if quoted and word in quoted:
            context["quoted"] = 1
        out.append((total, kind, context))
    return out


def judge(text: str, match: Matcher, context: dict[str, float] = PRIOR) -> tuple[float, str]:
    """(score, category) of a whole text: those of its worst window; 0 and none where no window is over 0."""
    best, _, kind = _worst(text, match, context)
    return best, kind


def _worst(text: str, match: Matcher, weights: dict[str, float]) -> tuple[float, tuple | None, str]:
    best: tuple[float, tuple | None, str] = (0.0, None, "")
    known: list[frozenset] = []

    def named() -> frozenset:
        if not known:
            known.append(people(text))
        return known[0]

    for s in _SENTENCE.split(plain(text)):
        for total, kind, context in windows(s, match, named) if s else ():
            got = total + sum(weights[c] * n for c, n in context.items())
            if got > best[0]:
                best = (got, (total, context), kind)
    return best


#: The labelled samples that the context is fitted on: those with an even id. The others are for measuring.
FITTED_SAMPLES = 1000


def fit_context(samples: list[tuple[int, str, str]], rounds: int = 3, steps: int = 200, rate: float = 0.05, spread: float = 0.15, sharpness: float = 6.0) -> dict[str, float]:
    """What context adds to a window, fitted on (id, text, label) by logistic regression around PRIOR.

    A text is its worst window under the weights of the round before. The prior is a normal distribution of `spread` around
    PRIOR, so that what the samples do not speak of stays as it is.
    """
    match, weights = Matcher(), dict(PRIOR)
    names = list(PRIOR)
    start = np.array([PRIOR[n] for n in names])
    for _ in range(rounds):
        rows = [(got, label != "none") for _, text, label in samples if text and (got := _worst(text, match, weights)[1]) is not None]
        if not rows:
            return dict(PRIOR)
        base = np.array([total for (total, _), _ in rows])
        x = np.array([[context.get(n, 0) for n in names] for (_, context), _ in rows], float)
        y = np.array([bad for _, bad in rows], float)
        w = start.copy()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-sharpness * (base + x @ w - THRESHOLD)))
            w -= rate * (sharpness * x.T @ (p - y) + (w - start) / spread**2) / len(rows)
        weights = dict(zip(names, w.tolist()))
    return weights


def fitted_context(samples: DataFrame) -> dict[str, float]:
    """`fit_context` on at most FITTED_SAMPLES labelled samples of even id, lowest first."""
    rows = samples.select("sample_id", "text", "label").where("sample_id % 2 = 0 and label is not null").orderBy("sample_id").limit(FITTED_SAMPLES).collect()
    return fit_context([(r["sample_id"], r["text"], r["label"]) for r in rows])


def scored(df: DataFrame, ident: str, text: str, keep: tuple[str, ...] = (), context: dict[str, float] = PRIOR) -> DataFrame:
    """`ident`, `keep`, score double, category string and flagged boolean of every row.

    Null and empty texts have score 0, no category and are not flagged. Whole texts are read, however long.
    """
    columns = [ident, *keep]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*columns).dtypes)

    def run(batches):
        match = Matcher()
        for batch in batches:
            got = [judge(t, match, context) if t else (0.0, "") for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(columns))],
                    pa.array([min(1.0, x / (2 * THRESHOLD)) for x, _ in got], pa.float64()),
                    pa.array([c if x >= THRESHOLD else None for x, c in got], pa.string()),
                    pa.array([x >= THRESHOLD for x, _ in got], pa.bool_()),
                ],
                names=[*columns, "score", "category", "flagged"],
            )

    return df.select(*columns, text).mapInArrow(run, f"{kinds}, score double, category string, flagged boolean")


def flagged_documents(documents: DataFrame, context: dict[str, float] = PRIOR) -> DataFrame:
    """(doc_id) of the documents with at least one abusive, hateful or sexually explicit passage, once each."""
    return scored(documents, "doc_id", "text", context=context).where("flagged and doc_id is not null").select("doc_id").dropDuplicates(["doc_id"])


def document_scores(documents: DataFrame, context: dict[str, float] = PRIOR) -> DataFrame:
    """(doc_id, source, score, category, flagged) of every document."""
    return scored(documents, "doc_id", "text", ("source",), context)


def source_rates(documents: DataFrame, context: dict[str, float] = PRIOR) -> DataFrame:
    """(source, documents, flagged, rate, abusive, hateful, sexual) per source; a null source is a source of its own."""
    rows = checkpointed(document_scores(documents, context))
    kinds = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), *kinds)
