"""Free-text model answers and prompts as column expressions: labels with confidences, formats, checks.

White space at the ends is any Unicode white space, not blanks alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these exact words.
YES_WORDS = ["YES", "SÍ", "AFFIRMATIVE", "TRUE", "CORRECT"]
NO_WORDS = ["NO", "NEGATIVE", "FALSE", "INCORRECT", "ABSENT", "NOT PRESENT", "IS NOT PRESENT"]
SPEECH_WORDS = [
    "voice", "voices", "talking", "spoken", "speaking", "speaker", "conversation", "conversational", "words", "utterance",
    "vocal", "human voice", "person talking", "dialogue", "speech", "syllables", "phonemes", "formants", "laughter", "laugh",
    "laughing", "giggle", "giggling", "chuckle", "chuckling", "singing", "sing",
]
NONSPEECH_WORDS = [
    "music", "musical", "song", "melody", "instrumental", "beep", "beeps", "tone", "tones", "pitch", "sine wave", "noise",
    "noisy", "static", "hiss", "white noise", "silence", "silent", "quiet", "nothing", "empty", "ambient", "environmental",
    "background", "click", "clicks", "clock", "tick", "ticking", "engine", "motor", "vehicle", "car", "truck", "bus", "siren",
    "accelerating", "revving", "idling", "speeding", "spray", "splash", "power tool", "effect", "sound effect", "ringtone",
    "telephone",
]
PARSE_NONSPEECH = ["NONSPEECH", "NON SPEECH", "NOSPEECH", "NO SPEECH"]
PARSE_QUIET = ["NOISE", "SILENCE", "SILENT", "MUSIC", "BACKGROUND", "AMBIENT", "QUIET"]
PARSE_NEGATORS = ["NO", "NOT", "NONE", "WITHOUT", "ISNT", "DOESNT"]
PARSE_DENIALS = ["THERE IS NO", "THERE ISNT", "DOES NOT CONTAIN", "NO AUDIO", "NOT DETECTED", "NO"]
PARSE_AFFIRMATIONS = ["THERE IS", "CONTAINS", "PRESENT", "YES", "DETECTED", "VOICE", "HUMAN"]
FORBIDDEN_TOKENS = ["<|audio_bos|>", "<|AUDIO|>", "<|audio_eos|>", "<|im_start|>", "<|im_end|>", "<audio>", "</audio>"]
AUDIO_WORDS = ["AUDIO", "SOUND", "HEAR", "LISTEN", "WHAT", "DESCRIBE", "IDENTIFY", "CLASSIFY"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _count_of(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def _word(words: list[str]) -> str:
    return r"(?U)\b(" + "|".join(words) + r")\b"


#: Letters whose capitals are several code points: case that goes letter by letter leaves them letters.
_LONG_CAPITALS = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)


class Unicode:
    """Words, white space and case as the reference's expressions take them."""

    stripped, other = staticmethod(strip), r"(?U)[^A-Z0-9\s]"
    upper, lower = staticmethod(F.upper), staticmethod(F.lower)
    no = staticmethod(_word)
    yes = staticmethod(lambda w: _word([w]))
    negated = staticmethod(lambda w: rf"(?U)\b(NO|NOT)\b.*\b{w}\b")
    denied = r"(?U)\bNO\b.*\bSPEECH\b"


class Ascii:
    """As DuckDB takes them: ASCII words (an affirmation alone has Unicode letters and numbers around it) and white space, lines that end at \\n only, case letter by letter."""

    stripped, other = staticmethod(lambda text: F.regexp_replace(text, r"\A[\t\n\f\r ]+|[\t\n\f\r ]+\z", "")), r"[^A-Z0-9\t\n\f\r ]"
    apart = r"[^\p{L}\p{N}\p{Cs}_]"  # Java's search also begins at the second half of a code point
    upper = staticmethod(lambda text: F.upper(F.translate(text, _LONG_CAPITALS, "\u05d0" * len(_LONG_CAPITALS))))
    lower = staticmethod(lambda text: F.lower(F.translate(text, "\u0130", "i")))
    no = staticmethod(lambda words: rf"(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])")
    yes = staticmethod(lambda w: rf"(^|{Ascii.apart}){w}(\z|{Ascii.apart})")
    negated = staticmethod(lambda w: rf"{Ascii.no(['NO', 'NOT'])}[^\n]*{Ascii.apart}{w}(\z|{Ascii.apart})")
    denied = r"(?<![A-Za-z0-9_])NO(?![A-Za-z0-9_])[^\n]*(?<![A-Za-z0-9_])SPEECH(?![A-Za-z0-9_])"


def _result(label: str | None, confidence: Column) -> Column:
    return F.struct(F.lit(label).cast("string").alias("label"), confidence.cast("double").alias("confidence"))


def normalize_response(text: Column, confidence: Column | None = None, mapping: Column | None = None, verbalizers: tuple[str, ...] = ("SPEECH", "NONSPEECH"), letter_probs: Column | None = None, rules: type = Unicode) -> Column:
    """struct(label, confidence) of a free answer: explicit labels, mapped letters, yes and no, then counted synonyms. ``rules``: what words, white space and capitals are."""
    upper, lower = rules.upper(rules.stripped(text)), rules.lower(rules.stripped(text))
    base = F.coalesce(confidence if confidence is not None else F.lit(None), F.lit(1.0))
    listed = {v.upper() for v in verbalizers}

    nonspeech = any_of(upper, ["NONSPEECH", "NON-SPEECH", "NO SPEECH"]) & ~any_of(upper, ["NOT NONSPEECH", "NO NONSPEECH"])
    denied = any_of(upper, ["NONSPEECH", "NON-SPEECH", "NO SPEECH", "NOT SPEECH"]) | upper.rlike(rules.denied) | upper.startswith("NO,")
    speech = upper.contains("SPEECH") & ~denied

    steps: list[tuple[Column, Column]] = [(text.isNull() | (text == ""), _result(None, F.lit(0.0)))]
    if "NONSPEECH" in listed:
        steps.append((nonspeech, _result("NONSPEECH", base)))
    if "SPEECH" in listed:
        steps.append((speech, _result("SPEECH", base)))
    if mapping is not None:
        letter = F.regexp_extract(upper, "^([A-D])", 1)
        found = F.map_contains_key(mapping, letter)
        own = F.coalesce(F.try_element_at(letter_probs, letter), base) if letter_probs is not None else base
        steps.append(((letter != "") & F.coalesce(found, F.lit(False)), F.struct(F.try_element_at(mapping, letter).alias("label"), own.cast("double").alias("confidence"))))
    steps.append((upper.rlike(rules.no(NO_WORDS)), _result("NONSPEECH", base * 0.95)))
    yes = reduce(lambda a, b: a | b, [upper.rlike(rules.yes(w)) & ~upper.rlike(rules.negated(w)) for w in YES_WORDS])
    steps.append((yes, _result("SPEECH", base * 0.95)))
    for_speech, against = _count_of(lower, SPEECH_WORDS), _count_of(lower, NONSPEECH_WORDS)
    steps.append((for_speech > against, _result("SPEECH", base * 0.8)))
    steps.append((against > for_speech, _result("NONSPEECH", base * 0.8)))
    steps.append((for_speech > 0, _result("SPEECH", base * 0.6)))
    return _first(steps, _result(None, F.lit(0.0)))


def _first(steps: list[tuple[Column, Column]], default: Column) -> Column:
    chain = F.when(*steps[0])
    for condition, value in steps[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def parse_response(text: Column, rules: type = Unicode) -> Column:
    """struct(label, confidence) by the older cascade: option letters, labels, key words, negations and affirmations."""
    upper = rules.upper(rules.stripped(F.coalesce(text, F.lit(""))))
    plain = F.regexp_replace(upper, rules.other, "")
    before = F.substring_index(plain, "SPEECH", 1)
    steps = [
        (upper.contains("A)") | (upper == "A") | (plain == "A"), _result("SPEECH", F.lit(1.0))),
        (any_of(upper, ["B)", "C)", "D)"]) | plain.isin("B", "C", "D"), _result("NONSPEECH", F.lit(1.0))),
        (any_of(plain, PARSE_NONSPEECH), _result("NONSPEECH", F.lit(1.0))),
        (any_of(plain, PARSE_QUIET), _result("NONSPEECH", F.lit(0.9))),
        (plain.contains("SPEECH") & any_of(before, PARSE_NEGATORS), _result("NONSPEECH", F.lit(0.9))),
        (plain.contains("SPEECH"), _result("SPEECH", F.lit(1.0))),
        (any_of(plain, PARSE_DENIALS), _result("NONSPEECH", F.lit(0.8))),
        (any_of(plain, PARSE_AFFIRMATIONS), _result("SPEECH", F.lit(0.8))),
    ]
    return _first(steps, _result("UNKNOWN", F.lit(0.0)))


def resolve_prediction(text: Column, rules: type = Unicode, **options) -> Column:
    """Label of the first cascade, else of the second."""
    return F.coalesce(normalize_response(text, rules=rules, **options)["label"], parse_response(text, rules)["label"])


def detect_prompt_format(text: Column) -> Column:
    upper = F.upper(text)
    has = lambda *words: reduce(lambda a, b: a & b, [upper.contains(w) for w in words])
    return F.when(has("A)", "D)"), "mc").when(has("A)", "B)") | has("OPTION A", "OPTION B"), "ab").when(has("SPEECH", "NONSPEECH"), "labels").otherwise("open")


def valid_mapping(mapping: Column, label_space: list[str]) -> Column:
    """Whether a letter mapping names known labels only; no mapping is valid."""
    space = F.array(*[F.lit(v) for v in label_space])
    return mapping.isNull() | F.forall(F.map_values(mapping), lambda v: F.coalesce(F.array_contains(space, v), F.lit(False)))


def clean_prompt(text: Column, open_ended: bool = False) -> Column:
    """struct(text, valid, reason) of a prompt candidate; white space collapses in valid ones only."""
    own = strip(F.coalesce(text, F.lit("")))
    upper = F.upper(own)
    if open_ended:
        off_topic, reason = ~any_of(upper, AUDIO_WORDS), "no audio reference"
    else:
        off_topic, reason = ~upper.contains("SPEECH"), "missing labels"
    # Every text with both labels contains the shorter one, and either suffices.
    why = (
        F.when(any_of(own, FORBIDDEN_TOKENS), "forbidden token").when(F.char_length(own) < 10, "too short").when(F.char_length(own) > 300, "too long").when(off_topic, reason)
    )
    cleaned = F.when(why.isNull(), strip(F.regexp_replace(own, r"(?U)\s+", " "))).otherwise(own)
    return F.struct(cleaned.alias("text"), why.isNull().alias("valid"), why.alias("reason"))
