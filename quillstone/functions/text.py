"""Text functions as Column expressions; nulls stay null unless a docstring says otherwise."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that hint at a usage; counted without overlap on the lower-case text.
USAGE_INDICATORS = (
    "use",
    "mostly for",
    "good for",
    "suitable for",
    "perfect for",
    "ideal for",
    "works well for",
    "designed for",
    "intended for",
    "applications include",
    "multi-purpose",
    "purpose",
    "great for",
    "utilize",
    "utilise",
    "helpful",
    "using",
    "excellent for",
)
#: Milliseconds of reading time a character.
READING_MS = 14.69
NO_USAGE = "no usage options"


def words(text: Column) -> Column:
    """Words between white space, as split() without arguments gives them."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentence_count(text: Column) -> Column:
    """Pieces between [.!?]+ and white space that have more than two words; at least 1."""
    pieces = F.split(text, "[.!?]+(?:\\s+|$)")
    return F.greatest(F.lit(1), F.size(F.filter(pieces, lambda p: F.size(words(p)) > 2))).cast("long")


def char_count(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(text, "\\s", "")).cast("long")


def letter_count(text: Column) -> Column:
    """Characters that are neither white space nor ASCII punctuation."""
    return F.length(F.regexp_replace(text, "[\\s\\p{Punct}]", "")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def avg_word_length(text: Column) -> Column:
    return ratio(letter_count(text), word_count(text))


def seconds_to_read(chars: Column) -> Column:
    return F.round(chars * F.lit(READING_MS) / F.lit(1000.0), 2)


def reading_time(text: Column) -> Column:
    """Seconds."""
    return seconds_to_read(char_count(text))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("long")


def usage_count(text: Column, indicators: tuple[str, ...] = USAGE_INDICATORS) -> Column:
    low = F.lower(text)
    total = occurrences(low, indicators[0])
    for phrase in indicators[1:]:
        total = total + occurrences(low, phrase)
    return total


def usage_density(text: Column) -> Column:
    return ratio(usage_count(text), word_count(text))


def syllable_count(text: Column) -> Column:
    """Groups of vowels in the lower-case words, a silent final e left out, one a word at least."""
    def of(w: Column) -> Column:
        core = F.regexp_replace(F.lower(w), "[^a-z]", "")
        groups = F.size(F.filter(F.split(F.regexp_replace(core, "(?<=[^aeiouy])e$", ""), "[^aeiouy]+"), lambda v: v != ""))
        return F.greatest(F.lit(1), groups)

    return F.aggregate(words(text), F.lit(0), lambda n, w: n + of(w)).cast("long")


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    """206.835 - 1.015 words a sentence - 84.6 syllables a word. 0 without words."""
    score = F.lit(206.835) - F.lit(1.015) * (words / sentences) - F.lit(84.6) * ratio(syllables, words)
    return F.when(words == 0, F.lit(0.0)).otherwise(F.round(score, 2))


def flesch_reading_ease(text: Column) -> Column:
    """The reading ease of a text; approximate, as syllables are guessed by rule."""
    return reading_ease(word_count(text), sentence_count(text), syllable_count(text))


def truncate_words(text: Column, n: int) -> Column:
    """The first n words, one space between them."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def normalise_phrase(phrase: Column) -> Column:
    return F.array_join(words(F.lower(phrase)), " ")


def distinct_phrases(phrases: Column) -> Column:
    """Normalised phrases, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(phrases, normalise_phrase)))


def symbols_to_spaces(text: Column) -> Column:
    """All but ASCII letters, digits, + and & become a space."""
    return F.regexp_replace(text, "[^a-zA-Z0-9+&]", " ")


def join_options(options: Column) -> Column:
    return F.array_join(options, "; ")


def split_options(text: Column) -> Column:
    """Options between "; "; the phrase for none gives no options."""
    pieces = F.filter(F.transform(F.split(text, "; ", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(F.trim(text)) == NO_USAGE, F.array().cast("array<string>")).otherwise(pieces)


def parse_completion(text: Column) -> Column:
    """Options in a completion: what follows the first "Result:", between semicolons, up to the first
    piece that begins with "No usage options"; trimmed, and of dots too. Empty pieces stay."""
    after = F.when(F.contains(text, F.lit("Result:")), F.substring(text, F.locate("Result:", text) + 7, F.length(text))).otherwise(text)
    pieces = F.transform(F.split(after, ";", -1), lambda x: F.trim(x))
    stop = F.array_position(F.transform(pieces, lambda x: F.startswith(x, F.lit("No usage options"))), True)
    kept = F.when(stop > 0, F.slice(pieces, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(pieces)
    return F.transform(kept, lambda x: F.btrim(x, F.lit(".")))


def parse_generated_review(text: Column) -> Column:
    """[title, headline, body] of a generated review: three pieces between "; ", or three "name: value" pieces
    between empty lines or lines; else ["Error", "Error", text]."""
    pieces = F.split(text, "; ", -1)
    options = [F.when(F.size(pieces) >= 3, F.slice(pieces, 1, 3))]
    for between in ("\n\n", "\n"):
        values = F.transform(F.slice(F.split(text, between, -1), 1, 3), lambda x: F.get(F.split(x, ": ", -1), F.lit(1)))
        options.append(F.when((F.size(values) == 3) & F.forall(values, lambda v: v.isNotNull()), values))
    return F.coalesce(*options, F.array(F.lit("Error"), F.lit("Error"), text))


def fill_template(template: str, **values: Column) -> Column:
    """A template with {name} replaced by each value, null by nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def chat_messages(system: str, examples: list[tuple[str, str]], question: Column) -> Column:
    """array<struct<role, content>>: the system's turn, the examples' turns, the question."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(system))]
    for asked, answer in examples:
        turns += [turn("user", F.lit(asked)), turn("assistant", F.lit(answer))]
    return F.array(*turns, turn("user", question))


def label_id(model: str, prompt: str, suffix: str | None = None) -> str:
    return "-".join(x for x in (model, prompt, suffix) if x)


def crowd_label_id(vendor: str, run: str) -> str:
    return f"aws-{vendor}-{run}"


def artifact_label_id(artifact: str, checkpoint: str) -> str:
    return f"model-{artifact}-{checkpoint}"


def original_id(review_id: Column) -> Column:
    """The id of the review that an augmented one was made from."""
    return F.split_part(review_id, F.lit("."), F.lit(1))


def decode_label_string(label: Column) -> Column:
    """struct<usage, positive, amount> of "-" (none) or comma-joined triples whose third item is the positive flag."""
    items = F.split(label, ",", -1)
    flags = F.filter(items, lambda x, i: i % 3 == 2)
    none = label == "-"
    return F.struct(
        F.when(none, 0).otherwise(1).alias("usage"),
        F.when(none, 0).otherwise(F.when(F.get(flags, F.lit(0)) == "1", 1).otherwise(0)).alias("positive"),
        F.when(none, 0).otherwise(F.size(F.filter(flags, lambda x: x == "1"))).alias("amount"),
    )


def sum_logprobs(tokens: Column, logprobs: Column) -> Column:
    """Log-probabilities summed between "," tokens; line feeds are passed over."""
    pairs = F.arrays_zip(tokens.alias("t"), logprobs.alias("p"))
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        token = F.trim(x["t"])
        return F.when(
            token == ",",
            F.struct(F.concat(acc["done"], F.array(acc["sum"])).alias("done"), F.lit(0.0).alias("sum")),
        ).when(x["t"] == "\n", acc).otherwise(F.struct(acc["done"].alias("done"), (acc["sum"] + x["p"].cast("double")).alias("sum")))

    return F.aggregate(pairs, start, step, lambda acc: F.concat(acc["done"], F.array(acc["sum"])))


class _TextNodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def strip_html(text: str | None) -> str:
    """Entities first, then tags: so an escaped tag is a tag. Script, style and comments are no text. Null: empty."""
    parser = _TextNodes()
    parser.feed(unescape(text or ""))
    parser.close()
    return " ".join(" ".join(parser.parts).strip().encode("utf-8", "ignore").decode().split())


@F.pandas_udf(T.StringType())
def html_to_text(texts: pd.Series) -> pd.Series:
    return texts.map(strip_html)


# -- stemming: the algorithm published by M. F. Porter in 1980 --------------------------------


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or word[i] == "y" and i > 0 and not _vowel(word, i - 1)


def _short_end(w: str) -> bool:
    return len(w) >= 3 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


#: The suffix rules of steps 2, 3 and 4.
_STEP2 = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "abli": "able",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter_stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2 or not w.isalpha():
        return w
    has_vowel = lambda s: any(_vowel(s, i) for i in range(len(s)))
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e) and has_vowel(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        end = next((e for e in sorted(rules, key=len, reverse=True) if w.endswith(e)), None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = next((e for e in sorted(_STEP4, key=len, reverse=True) if w.endswith(e)), None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_phrases(phrases: pd.Series) -> pd.Series:
    """Each word of each phrase stemmed."""
    return phrases.map(lambda ps: None if ps is None else [" ".join(map(porter_stem, p.split())) for p in ps])
