"""Broken prompt and response pairs (problem 5).

A copy compresses to almost nothing with its prompt as zstandard dictionary; languages and refusals are told by
dictionaries; a response that breaks off is told by a terminal-context model: how often the words at its end
end a sentence elsewhere, counted over all responses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.bloom import Bloom, bloom, hashes_of_words, mix, word_hash
from clausewright.runtime import materialize

# Texts that stand for no answer.
PLACEHOLDERS = {
    "", "na", "none", "null", "nil", "nan", "no response", "no answer", "no reply", "response", "answer", "undefined", "unknown", "tbd", "tba", "todo", "to do", "empty",
    "blank", "placeholder", "not available", "not applicable", "n a", "error", "pending", "missing", "no content", "no data", "insert answer here", "your answer here", "lorem ipsum", "xxx", "test", "br", "void", "no output", "ai response", "sans réponse", "sin respuesta", "aucune réponse",
}
# Words that label a repeated question.
LABELS = set("you asked your question query q a answer prompt user input request the was is here response vous avez demandé votre demande question réponse r usted preguntó su pregunta consulta respuesta p".split())
# Frequent words of the languages.
LANGUAGES = {
    "en": "the a an and of to is are in for on with that this it you your can not may must shall be by at or from how what where who do does i my was has have any will there if under which section per year please no yes",
    "fr": "le la les un une des du de et est sont dans pour sur avec que qui ce cette il vous votre peut pas doit être par au aux ou quelle quel combien faut puis je près sans plus avant toute ne se coûte permis l d qu s n jours soit sera lieu a été",
    "es": "el la los las un una de del y es son en para por con que este esta usted su puede no debe ser al o cuánto cuesta qué cuál se sin más antes cerca permiso quien según hay lo está tiene mi días sea estar entregar más norma cada según otra vez",
    "de": "der die das ein eine einen einem einer und ist sind in im für auf mit dass dieser diese es sie ihr kann nicht muss werden wird von zu zur zum bei oder den dem des sich vor ohne nach über innerhalb wie darf wer beim an ab",
    "pt": "o a os as um uma de do da dos das e é são em no na para por com que este esta você seu pode não deve ser ao ou quanto qual se sem mais antes perto quem conforme uma foi será até",
    "it": "il lo la gli le un uno una di del della dei delle e è sono in nel nella per con che questo questa può non deve essere al alla o quanto quale si senza più prima vicino chi secondo giorni sarà da ogni",
    "nl": "de het een en van is zijn in voor op met dat deze dit u uw kan niet moet worden wordt door bij of om te aan als zonder meer voordat hoe wie binnen mag heeft naar",
    "pl": "i w z na do nie jest się że to przed przez dla od po musi może bez oraz każdy który są ma być należy",
    "sv": "och i att det som en ett på är av för med till den inte om har kan ska eller innan utan måste får från vid",
}
LANGUAGES = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}
_SPOKEN = {w: [k for k, v in LANGUAGES.items() if w in v] for w in set().union(*LANGUAGES.values())}
# Ways of declining, in the languages of the queries.
REFUSALS = [
    r"\b(?:i|we)(?:['’]m| am| are|['’]re)?(?: (?:really|truly|very|so))? (?:afraid )?(?:sorry|regret|apologi[sz]e)?,? ?(?:but )?(?:i |we )?(?:can ?not|can['’]t|won['’]t|will not|am unable|am not (?:able|permitted|allowed|in a position|authori[sz]ed)|(?:must|have to) (?:decline|refuse)|decline|refuse)\b",
    r"\b(?:i['’]m|i am|we are|we['’]re) (?:unable|not (?:able|permitted|allowed|in a position|authori[sz]ed|comfortable|going) to|not permitted)",
    r"\bi (?:must|have to|need to) (?:decline|refuse|pass)", r"\bi have been (?:told|asked|instructed|advised) (?:not|to avoid|to stay)", r"\boutside (?:of )?what i",
    r"\bguidelines? (?:prevent|forbid|prohibit)s?", r"\b(?:is|are) off limits", r"\bno can do\b", r"\bi['’]?(?:d| would) rather not\b", r"\bi (?:don['’]t|do not) feel comfortable",
    r"\bno (?:response|answer) (?:can|will|may) be (?:given|provided)", r"\bas an ai\b", r"\blanguage model\b", r"\bi prefer not\b", r"\bi (?:do not|don['’]t) (?:answer|discuss|comment|provide)\b",
    r"\b(?:topic|subject|something|matter|question)s? (?:that )?i (?:am|have|['’]m|can|must|will|do)[^.]{0,20}\b(?:not|avoid|cannot|never)\b", r"\b(?:cannot|can['’]t|not (?:able|allowed|permitted) to) (?:help|assist|answer|discuss|comment)\b",
    r"\b(?:go|goes|leave|left|remain|remains)\b[^.]{0,20}\bunanswered\b", r"\b(?:will|can|shall) not be (?:answering|answered|discuss(?:ing|ed))\b", r"\bnot (?:for|up to) me to (?:say|answer)\b",
    r"\bsomething i am not\b", r"\bbeyond (?:my|what i)\b", r"\bagainst my\b", r"\bnot something i\b",
    r"\bje (?:ne |n['’])(?:peux|puis|suis pas|souhaite|veux|dois|réponds|r)", r"\bje (?:suis )?désolée?\b", r"\bje préfère ne pas\b", r"\bil m['’]est (?:impossible|interdit)", r"\bje (?:regrette|refuse|dois refuser|dois décliner)\b", r"\bil ne m['’]est pas (?:permis|possible)", r"\baucune réponse ne peut\b",
    r"\bno puedo\b", r"\blo siento\b", r"\bprefiero no\b", r"\bno me (?:está|es) (?:permitido|posible)\b", r"\bno (?:estoy|soy) (?:en condiciones|autorizad|capaz)", r"\bme (?:niego|abstengo)\b", r"\blamento no\b", r"\bno se puede dar respuesta\b", r"\bdebo (?:negarme|rechazar|declinar)\b", r"\bno es posible responder\b",
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|möchten|werde|werden) (?:ihnen |dazu |darauf |das |diese frage |hierzu |leider |dabei |hier )*nicht\b", r"\btut mir leid\b", r"\bleider (?:kann|darf|ist es mir)\b", r"\bist (?:es )?mir nicht (?:möglich|erlaubt|gestattet)\b",
    r"\bnon (?:posso|possiamo|sono in grado|mi è (?:possibile|permesso|consentito))\b", r"\bmi dispiace\b", r"\b(?:devo|debbo) rifiutar", r"\bpreferisco non\b",
    r"\bnão (?:posso|podemos|me é (?:possível|permitido)|estou autorizad)", r"\b(?:sinto muito|lamento)\b", r"\bprefiro não\b", r"\brecuso-me\b",
    r"\b(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil|zal)(?: \w+){0,4} niet\b", r"\b(?:het )?spijt (?:me|mij|ons)\b",
    r"\bnie (?:mogę|możemy|jestem w stanie|wolno mi)\b", r"\bprzykro mi\b", r"\bodmawiam\b", r"\bjag (?:kan|får|vill) (?:tyvärr )?inte\b", r"\btyvärr kan\b",
    r"\bне (?:могу|можем|вправе|имею права|буду)\b", r"\b(?:извините|к сожалению|сожалею)\b", r"\bмне (?:не разрешено|нельзя)\b", r"\bотказываюсь\b",
]
# What goes with a refusal and says nothing.
FILLERS = [
    r"\bapologi[sz]e\b", r"\binconvenience\b", r"\bi hope you understand\b", r"\b(?:contact|consult|ask|speak (?:to|with)|seek|reach out|refer to|talk to)\b[^.]{0,60}\b(?:lawyer|professional|someone|town hall|attorney|expert|counsel|solicitor|municipality|city|staff|clerk|office|else)\b",
    r"\bsomething else\b", r"\banything else\b", r"\bthank(?:s| you)\b", r"^(?:sorry|unfortunately|regrettably|no can do|i['’]m sorry)[.!, ]*$", r"\b(?:help|assist) you with\b", r"\bquestions about .* off limits\b",
    r"\bdésolée?\b", r"\bexcus", r"\b(?:consulte[rz]|contacte[rz]|adresse[rz]|veuillez)\b", r"\bautre (?:question|chose|sujet)\b", r"\bmerci\b", r"\bcomprendre", r"\bcompréhension\b",
    r"\bdisculp", r"\b(?:consulte|contacte|póngase|dirígase|comuníquese)\b", r"\botr[ao] (?:pregunta|cosa|tema|consulta)\b", r"\bgracias\b", r"\bcomprenda\b", r"\bcomprensión\b", r"\bperdón\b",
    r"\bentschuldig", r"\bbitte wenden sie sich\b", r"\bdanke\b", r"\bandere(?:n|s)? (?:frage|thema)\b", r"\bscus[ai]", r"\bsi rivolga\b", r"\bgrazie\b", r"\bdesculp", r"\bobrigad", r"\bexcuses\b", r"\bneem contact\b", r"\bprzepraszam\b",
    r"\bпожалуйста,? обратитесь\b", r"\bспасибо\b", r"\bпростите\b",
]
_REFUSAL = re.compile("|".join(REFUSALS))
_FILLER = re.compile("|".join(FILLERS))
_TAG = re.compile(r"<[^<>]*>|&[a-z]+;|[\u200b-\u200f\ufeff\u2060]")
_URL = re.compile(r"https?://[\w.-]+\.\w+/\w[\w-]*/\w[\w-]*")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_LISTED = re.compile(r"\s*(?:[-*•]|\d+[.)])\s")
_CLOSE = "\"'”’»*_`)] "
DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")


def is_empty(response: str | None) -> bool:
    words = re.findall(r"[^\W_]+", _TAG.sub(" ", response or "").lower())
    return " ".join(words) in PLACEHOLDERS or "".join(words) in PLACEHOLDERS


def _norm(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _squeezed(words: list[str], dictionary: zstandard.ZstdCompressionDict) -> int:
    return len(zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=dictionary).compress(" ".join(words).encode()))


def _distance(a: list[str], b: list[str], most: int) -> int:
    """Words to change, insert or drop to make a of b; anything over most is most + 1."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def is_copy(query: str, response: str) -> bool:
    """Nothing but the query, perhaps labelled, repeated any number of times, or with one word in eight edited.

    With the query as dictionary the response takes little more room than the query itself: a few bytes for each repetition, label and
    edited word. What is that small is looked at word by word: between the copies only labels may stand. A query too short for a
    dictionary is compared by words alone.
    """
    q, r = _norm(query), _norm(response)
    edits = len(q) // 8
    if not q or len(r) < len(q) - edits:
        return False
    raw = " ".join(q).encode()
    if len(raw) >= 8:  # the least a dictionary can have
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        labels = sum(w in LABELS for w in r) - sum(w in LABELS for w in q) * max(1, len(r) // len(q))
        if _squeezed(r, dictionary) > _squeezed(q, dictionary) + 16 + (8 + 14 * edits) * (1 + len(r) // len(q)) + 10 * max(0, labels):
            return False
    at, hits, led, exact = 0, 0, -1, None
    while at < len(r):
        if led < at:  # labels stand before led
            led = next((i for i in range(at, len(r)) if r[i] not in LABELS), len(r) - 1)
            exact = next((i for i in range(at, led + 1) if r[i : i + len(q)] == q), None)
        if exact is not None:
            at, hits, led = exact + len(q), hits + 1, -1
            continue
        near = [(_distance(q, r[at : at + n], edits), n) for n in range(len(q) - edits, len(q) + edits + 1) if at + n <= len(r)] if edits else ()
        if near and min(near)[0] <= edits:
            at, hits, led = at + min(near)[1], hits + 1, -1
        elif r[at] in LABELS:
            at += 1
        else:
            return False
    return hits > 0


#: Scripts by the ranges of their letters; letters elsewhere are Latin.
_SCRIPTS = (("Greek", "\u0370", "\u03ff"), ("Cyrillic", "\u0400", "\u052f"), ("Hebrew", "\u0590", "\u05ff"), ("Arabic", "\u0600", "\u077f"), ("Devanagari", "\u0900", "\u097f"), ("Thai", "\u0e00", "\u0e7f"), ("Hangul", "\uac00", "\ud7af"), ("East Asian", "\u3040", "\u9fff"))


def script(text: str) -> str:
    """The script of most of the text's letters; '' without letters."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else ""
    seen = Counter(next((name for name, lo, hi in _SCRIPTS if lo <= c <= hi), "Latin") for c in text if c.isalpha())
    return max(seen, key=lambda k: (seen[k], k), default="")


def language(text: str) -> tuple[str, dict[str, int]]:
    """The language whose frequent words the text holds most of ('' if none stands out), and all counts."""
    words = _WORD.findall(text.lower().replace("’", "'"))
    counts = dict.fromkeys(LANGUAGES, 0)
    for w in words:
        for k in _SPOKEN.get(w, ()):
            counts[k] += 1
    best = sorted(counts, key=lambda k: (-counts[k], k))
    return (best[0] if counts[best[0]] > counts[best[1]] else ""), counts


def speaks_otherwise(query: str, response: str) -> bool:
    """Another script than the query's, or, in the same, the frequent words of another language."""
    asked, said = script(query), script(response)
    if asked and said and asked != said:
        return sum(map(str.isalpha, response)) > 10 or said != "Latin"
    _, q = language(query)
    lang, r = language(response)
    mine = max(q, key=lambda k: (q[k], k == "en"))
    return bool(q[mine]) and bool(lang) and lang != mine and r[lang] >= r[mine] + 2 and q[lang] < q[mine]


def is_refusal(response: str) -> bool:
    """A sentence declines, and no sentence says anything else of use."""
    said = [s.strip().lower() for s in re.split(r"(?<=[.!?])\s+|\n+", response) if _WORD.search(s)]
    refused = [bool(_REFUSAL.search(s)) for s in said]
    return any(refused) and all(x or _FILLER.search(s) for x, s in zip(refused, said))


def _shape(word: str) -> str:
    if _URL.match(word):
        return "<url>"
    return _DIGITS.sub("#", word.strip("\"'“”’«»*_`()[]>.,;:!?"))


def _listed(line: str) -> str:
    return "L" if _LISTED.match(line) else "S"


def contexts(line: str, only: Container[str] | None = None, shape: Callable[[str], str] = _shape) -> list[tuple[list[str], bool, bool]]:
    """For each word of a line (or those in `only`) the keys of its contexts, longest first, whether a sentence ends at it, and whether it is
    the line's last."""
    listed, tokens = _listed(line), line.split()
    shapes = list(map(shape, tokens))
    loose = ["Xx" if s[:1].isupper() else s for s in shapes]
    out = []
    for i, t in enumerate(tokens):
        if only is None or t in only:
            own = shapes[i].lower()
            keys = [" ".join([listed, *loose[i - n : i], own]) for n in (4, 3, 2, 1) if i >= n] + [f"{listed} {own}"]
            out.append((keys, i == len(tokens) - 1 or t.rstrip("\"'”’»*_`)]").endswith((".", "!", "?")), i == len(tokens) - 1))
    return out


def tail_keys(response: str) -> list[str] | None:
    """Contexts of the last word if the ending is open; None if it is closed; [] if it is broken off for certain."""
    text = _TAG.sub("", response).rstrip()
    body = text.rstrip(_CLOSE)
    if not body:
        return None
    last = text.split("\n")[-1]
    if re.search(r"[^\W\d_][-\u00ad¬]$", body) or body[-1] in ",;:(-–—" or last.count("(") > last.count(")") or last.count("“") > last.count("”"):
        return []
    if text[-1] in ")]" or body[-1] in "?!…":
        return None
    if body[-1] == "." and not re.search(r"\d\.$", body):
        return None
    words = last.split()
    found = contexts(last, words[-1:])
    return found[-1][0] if found else None


def _counter(asked: Bloom):
    """Partial counts of the contexts that pass the filter: how often a sentence ends there, goes on, or is left open by the response."""

    def flush(seen: Counter) -> pa.RecordBatch:
        keys = list({k for k, _ in seen})
        kept = [k for k, ok in zip(keys, asked.has(mix(word_hash(keys)))) if ok]
        rows = [(k, seen[k, True], seen[k, False], seen[k, None]) for k in kept]
        seen.clear()
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "ends", "goes_on", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            texts = [[x for x in _TAG.sub("", t or "").rstrip().split("\n") if x.strip()] for t in b.column("response").to_pylist()]
            # the shortest context of a word is the word: where it does not pass no longer one can be wanted
            shape = {t: _shape(t) for t in {t for lines in texts for x in lines for t in x.split()}}
            tokens = list(shape)
            shapes = [shape[t].lower() for t in tokens]
            ok = np.zeros(len(tokens), bool)
            for listed in "LS":
                ok |= asked.has(mix(word_hash([f"{listed} {s}" for s in shapes])))
            wanted = {t for t, x in zip(tokens, ok) if x}
            for lines in texts:
                for i, line in enumerate(lines):
                    if wanted.isdisjoint(line.split()):
                        continue
                    closed = line.rstrip(_CLOSE).endswith((".", "!", "?"))
                    for keys, end, last in contexts(line, wanted, shape.__getitem__):
                        how = None if last and i == len(lines) - 1 and not closed else end
                        for k in keys:
                            seen[k, how] += 1
                if len(seen) > 300_000:
                    yield flush(seen)
        yield flush(seen)

    return run


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, keys = [], []
        for q, r in zip(b.column("query").to_pylist(), b.column("response").to_pylist()):
            kind, tail = None, None
            if is_empty(r):
                kind = "empty"
            elif is_copy(q, r):
                kind = "copies_question"
            elif speaks_otherwise(q, r):
                kind = "other_language"
            elif is_refusal(r):
                kind = "refusal"
            else:
                tail = tail_keys(r)
                kind = "truncated" if tail == [] else None
            kinds.append(kind)
            keys.append(tail or None)
        yield pa.record_batch([b.column("id"), pa.array(kinds, pa.string()), pa.array(keys, pa.list_(pa.string()))], names=["id", "kind", "keys"])


def broken_pairs(log: DataFrame, *, id_col: str, query: str, response: str, status: str, least_end: float = 0.3, enough: int = 2) -> DataFrame:
    """(id, defect): rows with a non-blank query and a status that is null or `ok` whose response is defective.

    One defect a row, the first that holds of empty, copies_question, other_language, refusal, truncated. A null
    response is empty. An id delivered again counts once; under one id with several texts the smallest counts. Null
    ids are left out, an empty log has no defects. Of the contexts in all responses those of open endings are counted in the cluster
    and joined to these; a Bloom filter of bounded size tells which they are.
    """
    rows = log.select(F.col(id_col).cast("bigint").alias("id"), F.col(query).alias("query"), F.col(response).alias("response"), F.col(status).alias("status")).filter("id is not null")
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("query", "response", "status")).alias("s")).select("id", "s.*"))
    due = rows.filter(F.length(F.trim(F.regexp_replace("query", r"\s+", " "))) > 0).filter("status is null or lower(trim(status)) = 'ok'")
    labelled = materialize(due.select("id", "query", "response").mapInArrow(_label, "id bigint, kind string, keys array<string>"))
    tails = labelled.filter("keys is not null").select("id", F.posexplode("keys").alias("at", "key"), F.size("keys").alias("n"))
    asked = bloom(materialize(tails.select("key").distinct().mapInArrow(hashes_of_words, "h bigint")))
    known = rows.mapInArrow(_counter(asked), "key string, ends bigint, goes_on bigint, open bigint").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("ends", "goes_on", "open")))
    # numbers and addresses end as they do elsewhere, words must have been seen within or at the end of a sentence
    bare = F.col("key").rlike(r"(?:<url>|#)$")
    tails = tails.join(known, "key", "left").withColumn("goes", F.coalesce("goes_on", F.lit(0)))
    tails = tails.withColumn("ended", F.coalesce("ends", F.lit(0)) + F.when(bare, F.coalesce("open", F.lit(0)) - 1).otherwise(0))
    usable = (F.col("ended") + F.col("goes") >= F.when(F.col("at") == F.col("n") - 1, 1).otherwise(enough)).alias("usable")
    ends = tails.filter(usable).groupBy("id").agg(F.min_by(F.col("ended") / (F.col("ended") + F.col("goes")), "at").alias("p"))
    cut = labelled.filter("keys is not null").join(ends, "id", "left").filter(F.coalesce("p", F.lit(0.0)) < least_end).select("id", F.lit("truncated").alias("defect"))
    return labelled.filter("kind is not null").select("id", F.col("kind").alias("defect")).union(cut)
