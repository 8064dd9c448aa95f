"""Prompt and response pairs that are broken, with the kind of each defect.

Languages are compared by the posteriors of a naive Bayes model over hashed character trigrams of the prose: code,
identifiers, quotations and tables are left out on both sides. Truncated responses come from ``truncation``, whose
end-of-text trigram statistics cover all responses. Empty, refusing and copying responses are told by their words.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomgraph.llm.truncation import truncated_values
from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "pt", "ru")
#: The model is fitted on at most so many labelled documents of each language, those with the smallest hash of their id.
FIT_DOCUMENTS = 400
#: ... and then on so many calls at most, those with the smallest hash of their id.
FIT_CALLS = 8192
#: Trigrams are hashed into so many buckets: the model is LANGUAGES x BUCKETS numbers, whatever the corpus.
BUCKETS = 1 << 15
#: A language is told only if its log posterior leads by so much, over at least so many letters.
MARGIN, MIN_LETTERS = 10.0, 20

# Names of the languages in these languages (beginnings of words), by which a prompt asks for one.
LANGUAGE_NAMES = {
    "de": "german deutsch allemand alemán aleman alemão alemao tedesc немецк ドイツ語 德语",
    "en": "english englisch anglais inglés ingles inglês inglese английск 英語 英语",
    "es": "spanish spanisch espagnol español espanol espanhol spagnol испанск スペイン語 西班牙语",
    "fr": "french französisch franzosisch français francais francés frances francês frances french francese французск フランス語 法语",
    "it": "italian italienisch italien italiano итальянск イタリア語 意大利语",
    "ja": "japanese japanisch japonais japonés japones japonês giapponese японск 日本語 日语",
    "pt": "portuguese portugiesisch portugais portugués portugues português portoghese португальск ポルトガル語 葡萄牙语",
    "ru": "russian russisch russe ruso russo русск ロシア語 俄语",
}
_ASKED = {k: re.compile("|".join(rf"(?<![^\W\d_]){w}" if w[0] < "　" else w for w in v.split()), re.IGNORECASE) for k, v in LANGUAGE_NAMES.items()}

# How a response declines, and words for nothing.
_HELP = r"(?:assist|help|answer|respond|repl|complet|provid|produc|review|discuss|comment|go into|fulfil|do (?:this|that|so)|share|continu|process|support|compl[yi]|engage|talk|perform|carry|write|give|show|generat|create|handle|address|work on|participate|disclose|reveal|explain)"
_REFUSALS = re.compile(
    r"\b(?:I|we)(?:['’]m| am| are|['’]re)? ?(?:sorry,? but (?:I|we) )?(?:can(?:not|['’]t| not)|won['’]t|will not|am not able to|(?:am )?unable to|not able to|must (?:decline|refuse)|have to (?:decline|refuse)|(?:would|['’]d) rather not|"
    rf"decline to|refuse to|(?:am |['’]m )?not (?:allowed|permitted|authori[sz]ed) to|may not|do not|don['’]t)\b[^.!?\n]{{0,40}}?\b{_HELP}"
    rf"|\b(?:sorry|unfortunately|regret)\b[^.!?\n]{{0,30}}\b(?:not able|unable|can(?:not|['’]t)|won['’]t|not possible)\b[^.!?\n]{{0,20}}\b{_HELP}"
    rf"|\bnot possible for me to\b|\brequest (?:was |has been |is )?(?:declined|refused|denied|rejected)\b|\bas an? (?:AI|language model)\b[^.!?\n]{{0,40}}\b(?:cannot|can['’]t|unable|not able)\b"
    r"|\b(?:kann|darf|möchte|werde|können|dürfen)\b[^.!?\n]{0,60}\b(?:nicht|leider|keine)\b[^.!?\n]{0,40}(?:helfen|antworten|bearbeiten|unterstützen|beantwort|behilflich|erfüllen|besprechen)"
    r"|(?:désolé|regrette|ne (?:peux|puis|suis) pas|impossible)[^.!?\n]{0,60}(?:aider|répondre|assister|traiter|fournir|satisfaire)"
    r"|(?:no (?:puedo|podemos|me es posible)|lo siento)[^.!?\n]{0,60}(?:ayudar|responder|contestar|atender|asistir|proporcionar)"
    r"|(?:não (?:posso|podemos|consigo|me é possível)|lamento|desculp\w*|sinto muito)[^.!?\n]{0,60}(?:ajud|respond|atend|auxili|fornec)"
    r"|(?:non (?:posso|possiamo|mi è possibile|sono in grado)|mi dispiace|spiacente)[^.!?\n]{0,60}(?:aiut|rispond|assist|forni|soddisf)"
    r"|(?:не (?:могу|можем|буду)|извините|к сожалению)[^.!?\n]{0,60}(?:помочь|ответить|отвечать|выполнить|обсуждать|предоставить)"
    r"|(?:お手伝い|お答え|お応え|ご?対応|ご?回答|ご?協力|お力|お教え)[^。！？\n]{0,14}(?:できません|できかねます|いたしかねます|致しかねます|しかねます)"
    r"|(?:抱歉|对不起|无法|不能)[^。！？\n]{0,20}(?:帮助|回答|协助|提供|处理)",
    re.IGNORECASE,
)
# Refusals by permission, remit, topic or instruction, and announcements of no answer.
_WIDER = re.compile(
    rf"\bno (?:permission|authori[sz]ation|clearance|mandate) to\b[^.!?\n]{{0,20}}?\b{_HELP}"
    r"|\b(?:guidelines|instructions|rules|polic(?:y|ies)|restrictions)\b[^.!?\n]{0,30}\b(?:not (?:allow|permit|let)|forbid|prohibit|prevent)\w*\b[^.!?\n]{0,15}\b(?:me|us)\b"
    r"|\b(?:against|contrary to) my (?:instructions|guidelines|rules|polic)|\b(?:outside|beyond|not within)(?: of)? my (?:remit|scope|role|mandate|competence|purview)"
    r"|\b(?:off limits|out of bounds|closed|not (?:permitted|allowed)|forbidden|prohibited) (?:for|to) (?:me|us)\b|\b(?:I|we)\b[^.!?\n]{0,30}\bleave\b[^.!?\n]{0,15}\bunanswered\b"
    r"|\bno (?:answer|reply|response) (?:is|will be|can be|may be) (?:given|provided) to (?:this|that|the|your) (?:prompt|question|request)|\bwill be no (?:answer|reply|response) from (?:my|our) side"
    r"|^\W*no comment on (?:that|this)\b|\bI\b[^.!?\n]{0,50}\bskip this (?:one|question|request)\b|\bask (?:another|a different) (?:assistant|model)\b"
    r"|\b(?:ich|mir|wir|uns)\b[^.!?\n]{0,40}\b(?:nicht|keine)\b[^.!?\n]{0,30}\b(?:befugt|berechtigt|befugnis|berechtigung|erlaubnis|erlaubt|gestattet)\b"
    r"|\bje n['’]ai pas (?:le droit|l['’]autorisation|la permission)|\bne m['’]est pas permis|\bje ne suis pas (?:autorisé|habilité)"
    r"|\bno (?:estoy autorizad|tengo (?:permiso|autorización)|me está permitid|se me permite)|\bnão (?:tenho (?:permissão|autorização)|estou autorizad|me é permitid)"
    r"|\bnon (?:mi è (?:permesso|consentito)|ho il permesso|sono autorizzat)|\bмне (?:не разрешено|не позволено|запрещено)|\bне имею права|\bу меня нет (?:права|разрешения)"
    r"|(?:許可|権限)[^。！？\n]{0,10}(?:おりません|いません|ありません|ございません)|回答(?:は|を)?(?:差し)?控え|お受けでき(?:ません|かねます)",
    re.IGNORECASE,
)
# One of these stands in every text that _WIDER finds, in lower case.
_WIDER_CUES = ("no permission", "no authori", "no clearance", "no mandate", "not allow", "not permit", "not let", "forbid", "prohibit", "prevent", "against my", "contrary to my", "my remit", "my scope", "my role", "my mandate", "my competence", "my purview",
               "off limits", "out of bounds", "closed ", "unanswered", "no answer", "no reply", "no response", "no comment", "skip this", "ask another", "ask a different", "befug", "berechtig", "erlaub", "gestattet", "ai pas l", "est pas permis", "suis pas",
               "no estoy", "no tengo", "no me est", "no se me", "não ", "non mi è", "non ho il", "non sono", "мне ", "не имею", "у меня нет", "許可", "権限", "控え", "お受けでき")
# Words by which a sentence may be a refusal, if it also answers many prompts and has nothing of theirs.
_HINTS = re.compile(
    r"permi[ts]|allow|autori[szt]|authori|guideline|instruction|polic(?:y|ies)|safety|\bremit\b|off limits|\btopic|unanswered|no (?:answer|comment|reply)|declin|refus|\bskip|sorry|afraid|apolog|regret|forbid|prohibit"
    r"|erlaub|gestatt|befug|richtlinie|\bthema|zuständig|leider|bedaur|consigne|\bsujet|désolé|lo siento|lament|\btema\b|desculp|consentit|argomento|dispiace|spiacent|разреш|запрещ|не имею|\bтем[аеуы]\b|извин|сожалени"
    r"|許可|権限|控え|申し訳|対象外|恐れ入り"
)
#: A sentence with a hint is a refusal if it answers so many different prompts with which it shares no word of content.
MIN_PROMPTS = 3
#: A sentence that shares so many words of more than four letters with the prompt is part of an answer, unless it declines.
SHARED = 3

# One of these stands in every text that _REFUSALS finds, in lower case.
_CUES = ("cannot", "can't", "can’t", "can not", "won't", "won’t", "will not", "able", "declin", "refus", "rather not", "allowed", "permitted", "authori", "may not", "do not", "don't", "don’t", "unfortunately", "sorry", "regret", "possible", "denied", "rejected",
         "kann", "darf", "möchte", "werde", "können", "dürfen", "désolé", "regrette", "ne p", "ne suis", "lo siento", "no pued", "no pod", "no me es", "não", "lamento", "desculp", "sinto muito", "non p", "non mi", "non sono",
         "mi dispiace", "spiacente", "не ", "извините", "к сожалению", "お", "ご", "対応", "回答", "協力", "抱歉", "对不起", "无法", "不能")
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s*|\n+")
_NAMES = re.compile(r"[a-z0-9][A-Z]|\d|“”")
_SKIPPED = r"</?[A-Za-z][^<>]*+>|```\w*+|[^\w←-⏿☀-➿\U0001f000-\U0001ffff]|[_ㅤᅟᅠ]"
#: a text with so few characters of content, wherever they stand, that it may be a word for nothing
_FEW = re.compile(rf"(?:{_SKIPPED})*+(?:[\w←-⏿☀-➿\U0001f000-\U0001ffff](?:{_SKIPPED})*+){{0,9}}+\Z")
_NOTHING = {"null", "none", "nil", "na", "undefined", "nan", "nul"}
_LABEL = re.compile(
    r"^\W*(?:question|prompt|q|user|input|request|frage|pregunta|pergunta|domanda|вопрос|質問|问题|task|query|instruction|(?:you|the user) (?:asked|wrote|said)|you want to know|your (?:question|request|prompt)(?: was| is)?"
    r"|du fragst|sie fragen|vous demandez|preguntas|você perguntou|hai chiesto|вы спросили)\s*[:：\-]\s*",
    re.IGNORECASE,
)
#: a text that is one quotation as a whole
_WHOLE_QUOTE = re.compile(r"^\s*(?:[\"“„«「'‘`>]+)([\s\S]*?)(?:[\"”“»」'’`]+)\s*[.!?。]?\s*\Z")

_FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")
_CODE_LINE = re.compile(r"^(?:[ \t]*(?:[@{}|#<]|/[/*]|\*[ /]|\*$).*|.*[;{}]|[ \t]{4,}.*|[ \t]*(?:public|private|protected|static|final|import|package)\b.*)[ \t\r]*$", re.MULTILINE)
_QUOTED = re.compile(r'"[^"\n]*"|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|`[^`\n]*`|「[^」\n]*」')
_NAME = re.compile(
    r"https?://\S+|<[^<>\n]*>|(?<![A-Za-z0-9_$./\\@-])(?=[A-Za-z]*(?:[a-z][A-Z]|[\d_/\\@$]|(?<=[A-Za-z])[.-][A-Za-z0-9]))[A-Za-z0-9_$./\\@-]+"
)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_TOKENS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
#: for texts of ASCII, which are most: all but letters and digits, or letters alone, becomes a blank
_WORDS_OF_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}
_LETTERS_OF_ASCII = {c: " " for c in range(128) if not chr(c).isalpha()}


def tokens(text: str) -> list[str]:
    """Words of a text in lower case, and single characters of scripts without blanks."""
    low = text.lower()
    return low.translate(_WORDS_OF_ASCII).split() if low.isascii() else _TOKENS.findall(low)


def _without_names(text: str) -> str:
    """The text without addresses, tags and names of code."""
    if "<" in text:
        return _NAME.sub(" ", text)
    kept = []  # nothing else that is looked for has white space in it, and most words are plain
    for word in text.split():
        core = word.strip(".,;:!?()")
        plain = core.isalpha() and (core.islower() or core.istitle() or core.isupper())
        kept.append(word if plain else _NAME.sub(" ", word))
    return " ".join(kept)


def prose(text: str) -> str:
    """The words of natural language in a text, in lower case, with single blanks."""
    if "```" in text:
        text = _FENCE.sub("\n", text)
    text = _QUOTED.sub(" ", _CODE_LINE.sub("", text))
    text = _without_names(text).lower()
    return " ".join(text.translate(_LETTERS_OF_ASCII).split()) if text.isascii() else _NOT_LETTERS.sub(" ", text).strip()


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character trigrams of all texts, and the text of each; trigrams cross no text's end."""
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 2 for t in texts])
    if len(joined) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = joined[:-2] * np.uint32(0x9E3779B1) + joined[1:-1] * np.uint32(0x85EBCA77) + joined[2:] * np.uint32(0xC2B2AE3D)  # modulo 2 ** 32
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(9)) & np.uint32(BUCKETS - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[:-2] == owner[2:]
    return h[whole].astype(np.int64), owner[:-2][whole]


#: Texts are scored in blocks of so many, which stay in a core's cache.
SCORED = 256


def languages(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES of each prose text, -1 where it can't be told."""
    scores, by_bucket = np.zeros((len(texts), len(model))), np.ascontiguousarray(model.T)
    for k in range(0, len(texts), SCORED):
        bucket, owner = _buckets(texts[k : k + SCORED])
        if len(bucket):
            first = np.flatnonzero(np.diff(owner, prepend=-1))  # of each text that has any trigram
            scores[k + owner[first]] = np.add.reduceat(by_bucket[bucket], first, axis=0)
    scores = scores.T
    best = np.argmax(scores, 0)
    top = np.sort(scores, 0)
    letters = np.array([len(t) * (2 if re.search("[぀-ヿ㐀-鿿]", t) else 1) for t in texts])
    return np.where((top[-1] - top[-2] >= MARGIN) & (letters >= MIN_LETTERS), best, -1)


def _counted(texts: DataFrame, judge: Callable[..., list[int]]) -> np.ndarray:
    """Trigram counts (LANGUAGES x BUCKETS) of pairs of texts (the first two columns) under the language that ``judge`` gives for each, from all columns (-1: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            labels = np.array(judge(*columns), np.int64)
            for own in columns[:2]:
                bucket, owner = _buckets([prose(t or "") for t in own])
                if len(bucket):
                    told = labels[owner] >= 0
                    np.add.at(total, (labels[owner][told], bucket[told]), 1)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], names=["language", "bucket", "n"])

    counted = texts.mapInArrow(count, "language bigint, bucket bigint, n bigint").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(LANGUAGES), BUCKETS))
    out[counted["language"].to_numpy(), counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return out


def _model(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.1) / (counts + 0.1).sum(1, keepdims=True))


def fit_languages(documents: DataFrame, calls: DataFrame | None = None) -> np.ndarray:
    """Log probabilities (LANGUAGES x BUCKETS) of hashed trigrams, from documents with a usable ``lang``, and then from pairs.

    ``documents``: doc_id, text, lang. Labels count without case, blanks and region. Some may be wrong: the model is a sum
    over up to ``FIT_DOCUMENTS`` documents of a language and bears that. Prompts are of another kind than documents, so
    the prompts and responses of ``FIT_CALLS`` calls (id, prompt, response) are added under the language that this model finds for
    the response, unless the prompt names a language: nearly all pairs are in one language.
    """
    label = F.substring_index(F.lower(F.btrim("lang", F.lit(" \t"))), "-", 1)
    labelled = documents.filter("text is not null").select("doc_id", label.alias("label")).filter(F.col("label").isin(*LANGUAGES))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= FIT_DOCUMENTS).drop("_n")
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.lit("").alias("none"), "text", "label")
    counts = _counted(sample, lambda _, __, labels: [LANGUAGES.index(x) for x in labels])
    if calls is None:
        return _model(counts)
    first = _model(counts)

    def judge(prompts: list[str], responses: list[str]) -> list[int]:
        found = languages([prose(r or "") for r in responses], first)
        return [-1 if any(x.search(p or "") for x in _ASKED.values()) else int(k) for p, k in zip(prompts, found)]

    ids = calls.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(FIT_CALLS)
    pairs = calls.select("id", "prompt", "response").join(F.broadcast(ids), "id").select("prompt", "response")
    return _model(counts + _counted(pairs, judge))


def is_empty(response: str | None) -> bool:
    """No content: white space, invisible characters, punctuation, empty markup or brackets, or a word for null."""
    if not response:
        return True
    if not _FEW.match(response):
        return False
    text = re.sub(r"</?[A-Za-z][^<>]*>|```\w*", " ", response)
    words = re.sub(r"[^\w←-⏿☀-➿\U0001f000-\U0001ffff]|[_ㅤᅟᅠ]", "", text)
    return not words or (words.lower() in _NOTHING and len(text.split()) <= 1)


def _unfenced(text: str, prompt: str) -> str | None:
    """The text without code fences that are empty or repeat lines of the prompt; None if one has code of its own."""
    if "```" not in text:
        return text
    asked = {x.strip() for x in prompt.splitlines()}
    for fence in _FENCE.findall(text):
        if any(x.strip() and x.strip() not in asked for x in fence.strip("`").splitlines()[1:]):
            return None
    return _FENCE.sub("\n", text)


def _declines(sentence: str) -> bool:
    low = sentence.lower()
    if any(cue in low for cue in _CUES) and _REFUSALS.search(sentence):
        return True
    return any(cue in low for cue in _WIDER_CUES) and _WIDER.search(sentence) is not None


def _no_answer(response: str, prompt: str) -> list[str]:
    """The sentences of a response, none if one of them answers: it is no declining one itself, and names something of the code or shares ``SHARED`` words of content with the prompt."""
    text = _unfenced(response, prompt)
    if text is None:
        return []
    text, asked, sentences, start = _QUOTED.sub(" “” ", text), None, [], 0
    for end in itertools.chain(_SENTENCE_END.finditer(text), [None]):  # most answers name something in their first sentence
        sentence, start = text[start : end.start() if end else None], end.end() if end else 0
        sentences.append(sentence)
        named = _NAMES.search(sentence) is not None
        if not named and len(sentence) > 5 * SHARED:  # a shorter one can't have so many such words
            asked = set(tokens(prompt)) if asked is None else asked
            named = len({w for w in tokens(sentence) if len(w) > 4} & asked) >= SHARED
        if named and not _declines(sentence):
            return []
    return sentences


def _any_declines(sentences: list[str]) -> bool:
    return any("“”" not in x and _declines(x) for x in sentences)


def is_refusal(response: str, prompt: str = "") -> bool:
    """The response declines, and nothing in it but the declining sentences names anything of the code."""
    return _any_declines(_no_answer(response, prompt))


def _words(text: str) -> str:
    return " ".join(tokens(text))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def hinted(sentences: list[str], prompt: str) -> list[tuple[int, int, bool]]:
    """Those sentences of a response with no answer that may be refusals: hash, hash of the prompt, no word of content shared."""
    found = []
    for sentence in sentences:
        if _HINTS.search(sentence.lower()):
            words = _words(sentence)
            content = {w for w in words.split() if len(w) > 4 and not _HINTS.search(w)}
            found.append((_number(words), _number(_words(prompt)), not content & set(_words(prompt).split())))
    return found


def is_copy(prompt: str, response: str) -> bool:
    """Nearly every word of the response, which has no code of its own, stands in the prompt beside the same neighbour."""
    if not prompt:
        return False
    said = response
    for _ in range(2):
        said = _LABEL.sub("", said)
    if m := _WHOLE_QUOTE.match(said):
        said = m[1]
    words, asked = tokens(said), tokens(prompt)
    if words and words == asked:  # an exact repetition is one at any length
        return True
    known = set(asked)
    if len(words) < 5 or sum(w in known for w in words) < 0.8 * len(words):
        return False
    pairs = set(zip(asked, asked[1:]))
    good = [p in pairs for p in zip(words, words[1:])]
    kept = sum(a or b for a, b in zip([False, *good], [*good, False]))
    if kept < 0.8 * len(words):
        return False
    # a whole sentence of the prompt has to be there: an answer, too, may consist of words of the question
    own_pairs = set(zip(words, words[1:]))
    sentences = (tokens(x) for x in re.split(r"(?<=[.:!?。？！])\s+|\n+", prompt))
    if not any(len(x) > 3 and sum(q in own_pairs for q in zip(x, x[1:])) >= 0.65 * (len(x) - 1) for x in sentences):
        return False
    # a changed piece of the prompt's code is an answer; a copy repeats what was asked in words
    own, theirs = prose(said), prose(prompt)
    if not own or "```" in response and "```" not in prompt:
        return False
    asked_words = tokens(theirs)
    return len(tokens(own)) >= min(4, len(asked_words))


def pair_defects(calls: DataFrame, model: np.ndarray) -> DataFrame:
    """(id, defect) of each call: empty, refusal, copy and language; for truncated see ``broken_pairs``.

    ``calls``: id, prompt, response, success; other columns are ignored. A failed call whose response is null or blank
    gives nothing, a null success counts as one. Null prompts are like empty ones. Rows may be repeated. Refusals are told by
    their words, or by weaker words in a sentence that answers at least ``MIN_PROMPTS`` different prompts.
    """
    shared = calls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, defects, both, at, maybe = [], [], [], [], []
            for i, prompt, response, ok in zip(*(c.to_pylist() for c in batch.columns)):
                prompt = prompt or ""
                if is_empty(response):
                    if ok is not False:
                        ids.append(i)
                        defects.append("empty")
                    continue
                sentences = _no_answer(response, prompt)
                if _any_declines(sentences):
                    ids.append(i)
                    defects.append("refusal")
                elif is_copy(prompt, response):
                    ids.append(i)
                    defects.append("copy")
                else:
                    maybe += [(i, *x) for x in hinted(sentences, prompt)]
                a, b = prose(prompt), prose(response)
                if len(a) >= MIN_LETTERS // 2 and len(b) >= MIN_LETTERS // 2:
                    both += [a, b]
                    at.append((i, prompt))
            found = languages(both, shared.value)
            for (i, prompt), a, b in zip(at, found[::2], found[1::2]):
                if a >= 0 and b >= 0 and a != b and not _ASKED[LANGUAGES[b]].search(prompt):
                    ids.append(i)
                    defects.append("language")
            none = [None] * len(ids)
            a, b, c, e = map(list, zip(*maybe)) if maybe else ([], [], [], [])
            columns = [pa.array(ids + a, pa.int64()), pa.array(defects + ["refusal"] * len(a), pa.string()), pa.array(none + b, pa.int64()), pa.array(none + c, pa.int64()), pa.array(none + e, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "defect", "sentence", "asked", "apart"])

    rows = calls.select(F.col("id").cast("bigint").alias("id"), "prompt", "response", "success").filter("success is not false or trim(response) <> ''")
    told = checkpointed(rows.mapInArrow(run, "id bigint, defect string, sentence bigint, asked bigint, apart boolean"))
    usual = told.filter("apart").groupBy("sentence").agg(F.countDistinct("asked").alias("prompts")).filter(F.col("prompts") >= MIN_PROMPTS)
    refused = told.filter("sentence is not null").join(usual, "sentence", "left_semi")
    return told.filter("sentence is null").select("id", "defect").unionByName(refused.select("id", "defect"))


def broken_pairs(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, defect), one row for each defect of a call; see ``pair_defects`` and ``truncated_values``."""
    responses = calls.select(F.lit("llm_call_metrics").alias("table_name"), F.col("id").cast("bigint").alias("id"), F.lit("response").alias("field_name"), F.col("response").alias("text"))
    truncated = truncated_values(responses).select("id", F.lit("truncated").alias("defect"))
    return pair_defects(calls, fit_languages(documents, calls)).unionByName(truncated).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "llm_call_metrics"), table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found}
SQL: dict[str, str] = {}
