"""Queries for tokenising, vocabulary, sequences (F) and embeddings (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from biasframe.functions import sqltext as S
from biasframe.functions import text as X
from biasframe.functions.labels import at_least
from biasframe.operators import embed as G
from biasframe.operators import normalize as N
from biasframe.operators import partition as P
from biasframe.operators import sample as H
from biasframe.operators import vocab as V
from biasframe.operators import wordpiece as W
from biasframe.operators.gather import PIECE, encode_arrays
from biasframe.operators.ordering import attach_row, spread, stored
from biasframe.schema import SCORED_IDENTITIES, SUBTYPE_COLUMNS
from biasframe.sources.comments import comments, with_comments
from biasframe.sources.tables import table

EMBED_DIM = 64
NUM_WORDS = 10000
SEQ_LEN = 250
FEW_WORDS, FEW_WORDS_LEN = 1000, 150
MODEL_LEN = 128
UNKNOWN, CLS, SEP = 1, 2, 3


# ----------------------------------------------------------------- corpora
def doc_corpus(spark, sf_dir):
    """train (labelled) + test (unlabelled) documents, cleaned."""
    d = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    d = d.select("id", X.clean("text").alias("text"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return V.corpus([d.join(lab, "id", "left_semi"), d.join(lab, "id", "left_anti")])


def doc_vocab(spark, sf_dir):
    return V.fit_vocabulary(doc_corpus(spark, sf_dir), V.NEWLINE_TAB_FILTERS)


def conv_docs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return spread(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), "id")


def conv_vocab(spark, sf_dir):
    return V.fit_vocabulary(V.corpus([conv_docs(spark, sf_dir)]), V.DEFAULT_FILTERS)


def _tokens_sql(t: str, filters: str) -> str:
    s = f"trim(regexp_replace(translate(lower(coalesce({t}, '')), {S.q(filters)}, {S.q(' ' * len(filters))}), ' +', ' ', 'g'))"
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END)"


def _doc_corpus_sql() -> str:
    return (f"docs AS (SELECT CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1 END AS part, "
            f"d.doc_id AS doc, {S.clean('d.text')} AS text FROM documents d)")


def _conv_corpus_sql() -> str:
    return "docs AS (SELECT 0 AS part, conv_id * 1000 + turn AS doc, text FROM conversations)"


def _vocab_sql(filters: str, sfx: str = "") -> str:
    """CTEs tok(part, doc, pos, word) and vocab(word, word_count, word_index)
    over docs (every name carries the suffix ``sfx``)."""
    return f"""
tk{sfx} AS (SELECT part, doc, {_tokens_sql('text', filters)} AS toks FROM docs{sfx}),
tok{sfx} AS (SELECT part, doc, unnest(toks) AS word, unnest(generate_series(0, len(toks) - 1)) AS pos FROM tk{sfx}),
fst{sfx} AS (SELECT word, part, doc, pos, row_number() OVER (PARTITION BY word ORDER BY part, doc, pos) AS rn FROM tok{sfx}),
cnt{sfx} AS (SELECT word, count(*) AS word_count FROM tok{sfx} GROUP BY word),
vocab{sfx} AS (SELECT c.word, c.word_count,
                 row_number() OVER (ORDER BY c.word_count DESC, f.part, f.doc, f.pos) AS word_index
          FROM cnt{sfx} c JOIN fst{sfx} f ON f.word = c.word AND f.rn = 1)"""


# ----------------------------------------------------------------- F queries
def vocabulary(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


def vocabulary_sql():
    return f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)} SELECT word, word_count, word_index FROM vocab"


def vocabulary_size(spark, sf_dir):
    return V.vocabulary_size(doc_vocab(spark, sf_dir))


def vocabulary_size_sql():
    return f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)} SELECT count(*) + 1 AS vocab_size FROM vocab"


def _doc_words(spark, sf_dir):
    """The documents' words as arrays, cleaned and cut once, and their vocabulary."""
    docs = stored(doc_corpus(spark, sf_dir).select("part", "doc", V.tokens("text", V.NEWLINE_TAB_FILTERS).alias("words")))
    vocab = V.vocabulary_from_tokens(docs.select("part", "doc", F.posexplode("words").alias("pos", "word")))
    return docs.select(F.col("doc").alias("id"), "words"), vocab


def encode_docs(spark, sf_dir):
    docs, vocab = _doc_words(spark, sf_dir)
    return encode_arrays(docs, "words", vocab)


def _encode_sql(cap: str = "") -> str:
    return f"""
enc AS (SELECT t.doc, list(v.word_index ORDER BY t.pos) AS ids FROM tok t JOIN vocab v ON v.word = t.word {cap}
        GROUP BY t.doc),
seqs AS (SELECT d.doc AS id, coalesce(enc.ids, []::BIGINT[]) AS ids FROM docs d LEFT JOIN enc ON enc.doc = d.doc)"""


def encode_docs_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)}, {_encode_sql()} "
            "SELECT id, ids FROM seqs")


def max_len(spark, sf_dir):
    docs, vocab = _doc_words(spark, sf_dir)
    return V.longest_known(docs, "words", vocab).select(F.col("max_len").cast("long"))


def max_len_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)}, {_encode_sql()} "
            "SELECT CAST(max(len(ids)) AS BIGINT) AS max_len FROM seqs")


def _conv_seqs(spark, sf_dir, num_words=None, vocab=None):
    docs = conv_docs(spark, sf_dir)
    vocab = vocab if vocab is not None else conv_vocab(spark, sf_dir)
    return V.encode(docs, vocab, num_words=num_words)


def pad_post(spark, sf_dir):
    return V.pad_to_longest(_conv_seqs(spark, sf_dir)).select("id", "padded")


def pad_post_sql():
    return (f"WITH {_conv_corpus_sql()}, {_vocab_sql(V.DEFAULT_FILTERS)}, {_encode_sql()}, "
            "m AS (SELECT max(len(ids)) AS n FROM seqs) "
            "SELECT id, list_concat(ids, list_transform(range(m.n - len(ids)), lambda x: 0::BIGINT)) AS padded FROM seqs, m")


def pad_pre(spark, sf_dir):
    s = _conv_seqs(spark, sf_dir, NUM_WORDS)
    return s.select("id", V.pad_pre("ids", SEQ_LEN).alias("padded"))


def pad_pre_sql():
    cap = f"AND v.word_index < {NUM_WORDS}"
    return (f"WITH {_conv_corpus_sql()}, {_vocab_sql(V.DEFAULT_FILTERS)}, {_encode_sql(cap)}, "
            f"k AS (SELECT id, CASE WHEN len(ids) > {SEQ_LEN} THEN ids[len(ids) - {SEQ_LEN - 1}:] ELSE ids END AS kept FROM seqs) "
            f"SELECT id, list_concat(list_transform(range({SEQ_LEN} - len(kept)), lambda x: 0::BIGINT), kept) AS padded FROM k")


def raw_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


def pad_pre_docs(spark, sf_dir):
    """F11 as the reference has it: the last 250 of the 10,000 first words'
    ids, and the last 150 of the 1,000 first words', of the document texts."""
    docs = raw_docs(spark, sf_dir)
    s = V.encode(docs, V.fit_vocabulary(V.corpus([docs])), num_words=NUM_WORDS)
    few = F.filter("ids", lambda i: i < FEW_WORDS)
    return s.select("id", V.pad_pre("ids", SEQ_LEN).alias("padded_250"), V.pad_pre(few, FEW_WORDS_LEN).alias("padded_150"))


def pad_pre_docs_sql():
    cap = f"AND v.word_index < {NUM_WORDS}"

    def padded(ids, n):
        kept = f"CASE WHEN len({ids}) > {n} THEN {ids}[len({ids}) - {n - 1}:] ELSE {ids} END"
        return f"list_concat(list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0::BIGINT), {kept})"

    return (f"WITH docs AS (SELECT 0 AS part, doc_id AS doc, text FROM documents), {_vocab_sql(V.DEFAULT_FILTERS)}, {_encode_sql(cap)}, "
            f"few AS (SELECT *, list_filter(ids, lambda i: i < {FEW_WORDS}) AS few_ids FROM seqs) "
            f"SELECT id, {padded('ids', SEQ_LEN)} AS padded_250, {padded('few_ids', FEW_WORDS_LEN)} AS padded_150 FROM few")


def model_inputs(spark, sf_dir):
    vocab = conv_vocab(spark, sf_dir)
    s = _conv_seqs(spark, sf_dir, vocab=vocab)
    top = vocab.agg(F.max("word_index").alias("_top"))
    s = attach_row(s, top)
    cols = V.model_inputs("ids", MODEL_LEN, F.col("_top") + 1, F.col("_top") + 2)
    return s.select("id", *cols)


def model_inputs_sql():
    b = f"ids[1:{MODEL_LEN - 2}]"
    return (f"WITH {_conv_corpus_sql()}, {_vocab_sql(V.DEFAULT_FILTERS)}, {_encode_sql()}, "
            "t AS (SELECT max(word_index) AS top FROM vocab), "
            f"q AS (SELECT id, list_concat([t.top + 1], {b}, [t.top + 2]) AS sq FROM seqs, t) "
            f"SELECT id, list_concat(sq, list_transform(range({MODEL_LEN} - len(sq)), lambda x: 0::BIGINT)) AS input_ids, "
            f"list_concat(list_transform(range(len(sq)), lambda x: 1), list_transform(range({MODEL_LEN} - len(sq)), lambda x: 0)) AS input_mask, "
            f"list_transform(range({MODEL_LEN}), lambda x: 0) AS segment_ids FROM q")


def _doc_pieces(spark, sf_dir):
    docs = stored(raw_docs(spark, sf_dir).select("id", V.tokens("text").alias("words")))
    vocab = V.vocabulary_from_tokens(docs.select(F.lit(0).alias("part"), F.col("id").alias("doc"), F.posexplode("words").alias("pos", "word")))
    return docs, stored(W.corpus_pieces(vocab))


def wordpiece_inputs(spark, sf_dir):
    """F12 on the document texts: words cut into the longest pieces of a piece
    vocabulary, as model inputs of fixed length."""
    docs, pieces = _doc_pieces(spark, sf_dir)
    ids = W.encode_pieces(docs, "words", pieces, UNKNOWN)
    return ids.select("id", F.size("ids").alias("n_pieces"), *V.model_inputs("ids", MODEL_LEN, CLS, SEP)[:2])


def wordpiece_inputs_sql():
    seq = f"list_concat([{CLS}::BIGINT], coalesce(g.ids, [])[1:{MODEL_LEN - 2}], [{SEP}::BIGINT])"
    return (f"WITH RECURSIVE docs AS (SELECT 0 AS part, doc_id AS doc, text FROM documents), {_vocab_sql(V.DEFAULT_FILTERS)}, "
            "w AS (SELECT word FROM vocab WHERE word_index <= 3000), l AS (SELECT DISTINCT unnest(string_split(word, '')) AS word FROM w), "
            "p AS (SELECT word AS piece FROM w UNION SELECT word FROM l UNION SELECT '##' || word FROM w WHERE length(word) <= 4 UNION SELECT '##' || word FROM l), "
            "pieces AS MATERIALIZED (SELECT piece, row_number() OVER (ORDER BY encode(piece)) + 3 AS i FROM p WHERE piece <> ''), "
            "cut AS (SELECT word, 0::BIGINT AS done, []::BIGINT[] AS ids FROM vocab UNION ALL "
            "SELECT word, done + n, list_append(ids, i) FROM (SELECT c.word, c.done, c.ids, n, pieces.i, row_number() OVER (PARTITION BY c.word ORDER BY n DESC) AS best "
            "FROM (SELECT *, unnest(range(1, least(length(word) - done, (SELECT max(length(piece)) FROM pieces)) + 1)) AS n FROM cut WHERE done < length(word)) c "
            "JOIN pieces ON pieces.piece = CASE WHEN c.done = 0 THEN substr(c.word, 1, n::INTEGER) ELSE '##' || substr(c.word, (c.done + 1)::INTEGER, n::INTEGER) END) WHERE best = 1), "
            f"whole AS (SELECT v.word, coalesce(any_value(c.ids), [{UNKNOWN}::BIGINT]) AS ids FROM vocab v LEFT JOIN cut c ON c.word = v.word AND c.done = length(v.word) GROUP BY v.word), "
            "g AS (SELECT t.doc, flatten(list(whole.ids ORDER BY t.pos)) AS ids FROM tok t JOIN whole USING (word) GROUP BY t.doc), "
            f"q AS (SELECT d.doc AS id, coalesce(len(g.ids), 0)::INTEGER AS n_pieces, {seq} AS sq FROM docs d LEFT JOIN g ON g.doc = d.doc) "
            f"SELECT id, n_pieces, list_concat(sq, list_transform(range({MODEL_LEN} - len(sq)), lambda x: 0::BIGINT)) AS input_ids, "
            f"list_concat(list_transform(range(len(sq)), lambda x: 1), list_transform(range({MODEL_LEN} - len(sq)), lambda x: 0)) AS input_mask FROM q")


def document_sentences(spark, sf_dir):
    """F2 on the document texts."""
    ex = raw_docs(spark, sf_dir).select("id", F.posexplode(V.sentences("text")).alias("sentence_no", "sentence"))
    return ex.select("id", "sentence_no", X.whitespace_tokens("sentence").alias("tokens"))


def document_sentences_sql():
    return sentence_corpus_sql().replace("conv_id * 1000 + turn AS id", "doc_id AS id").replace("FROM conversations", "FROM documents")


def sentence_corpus(spark, sf_dir):
    c = conv_docs(spark, sf_dir)
    ex = c.select("id", F.posexplode(V.sentences("text")).alias("sentence_no", "sentence"))
    return ex.select("id", "sentence_no", X.whitespace_tokens("sentence").alias("tokens"))


def sentence_corpus_sql():
    marked = f"regexp_replace(coalesce(text, ''), {S.q('([.!?])' + X.WHITESPACE_CLASS + '+')}, '\\1' || chr(1), 'g')"
    return (f"WITH s AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split({marked}, chr(1)), lambda x: trim(x) <> '') AS parts "
            "FROM conversations), e AS (SELECT id, unnest(parts) AS sentence, unnest(generate_series(0, len(parts) - 1)) AS sentence_no FROM s) "
            f"SELECT id, CAST(sentence_no AS INTEGER) AS sentence_no, {S.tokens('sentence')} AS tokens FROM e")


def example_records(spark, sf_dir):
    c = comments(spark, sf_dir).where(F.col("target").isNotNull())
    return c.select(F.col("id").alias("guid"), F.col("comment_text").alias("text_a"),
                    at_least("target", 0.5).cast("int").alias("label"))


def example_records_sql():
    return with_comments("SELECT id AS guid, comment_text AS text_a, CAST(target >= 0.5e0 AS INTEGER) AS label "
                         "FROM comments WHERE target IS NOT NULL")


# ----------------------------------------------------------------- G queries
def _vectors(spark, sf_dir, vocab):
    return G.vectors_by_rank(table(spark, sf_dir, "embeddings"), vocab)


def matrix(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    return G.embedding_matrix(vocab, _vectors(spark, sf_dir, vocab), EMBED_DIM)


def _zeros_sql(n: int | str = EMBED_DIM) -> str:
    return f"list_transform(range({n}), lambda x: 0::FLOAT)"


def matrix_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)} "
            f"SELECT v.word_index, coalesce(e.embedding, {_zeros_sql()}) AS vector FROM vocab v "
            "LEFT JOIN embeddings e ON e.vec_id = v.word_index - 1")


def coverage(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    return G.coverage(vocab, _vectors(spark, sf_dir, vocab))


def coverage_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)} "
            "SELECT count(*) FILTER (WHERE word_index - 1 IN (SELECT vec_id FROM embeddings)) AS n_found, "
            "count(*) FILTER (WHERE word_index - 1 NOT IN (SELECT vec_id FROM embeddings)) AS n_oov FROM vocab")


def oov_words(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    return P.word_set_difference(vocab, _vectors(spark, sf_dir, vocab))


def oov_words_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)} "
            "SELECT word FROM vocab WHERE word_index - 1 NOT IN (SELECT vec_id FROM embeddings)")


def _sequences(spark, sf_dir, seqs, vocab):
    """The stored sequences, the longest one's length attached, and the embedding matrix."""
    seqs = stored(seqs)
    m = G.embedding_matrix(vocab, _vectors(spark, sf_dir, vocab), EMBED_DIM)
    return attach_row(seqs, V.max_length(seqs)), m


def flatten(spark, sf_dir):
    """G4 on conversation turns, each padded to the longest."""
    vocab = conv_vocab(spark, sf_dir)
    seqs, m = _sequences(spark, sf_dir, V.encode(conv_docs(spark, sf_dir), vocab), vocab)
    return G.padded_vectors(seqs, m, EMBED_DIM, F.col("max_len")).select("id", "flat")


def flatten_docs(spark, sf_dir):
    """G4 on the document texts."""
    docs = raw_docs(spark, sf_dir)
    vocab = V.fit_vocabulary(V.corpus([docs]))
    seqs, m = _sequences(spark, sf_dir, V.encode(docs, vocab), vocab)
    return G.flatten_vectors(seqs, m, EMBED_DIM, length=F.col("max_len")).select(
        "id", "part", F.transform("flat", lambda x: F.round(x.cast("double"), 6)).alias("flat"), "padding")


def _pieces_sql(values: str = "flatten(list(coalesce(mat.vector, {zeros}) ORDER BY x.pos))") -> str:
    return (f"{_encode_sql()}, m AS (SELECT max(len(ids)) AS n FROM seqs), "
            f"p AS (SELECT id, ids, n, unnest(range(greatest((len(ids) - 1) // {PIECE}, 0) + 1)) AS part FROM seqs, m), "
            f"x AS (SELECT id, part, unnest(ids[part * {PIECE} + 1:(part + 1) * {PIECE}]) AS wi, "
            f"unnest(generate_series(1, len(ids[part * {PIECE} + 1:(part + 1) * {PIECE}]))) AS pos FROM p), "
            f"mat AS (SELECT v.word_index, e.embedding AS vector FROM vocab v JOIN embeddings e ON e.vec_id = v.word_index - 1), "
            f"f AS (SELECT x.id, x.part, {values.format(zeros=_zeros_sql())} AS flat FROM x LEFT JOIN mat ON mat.word_index = x.wi GROUP BY x.id, x.part), "
            f"pieces AS (SELECT p.id, p.part::INTEGER AS part, coalesce(f.flat, []) AS flat, "
            f"(CASE WHEN p.part = greatest((len(ids) - 1) // {PIECE}, 0) THEN (n - len(ids)) * {EMBED_DIM} ELSE 0 END)::BIGINT AS padding "
            "FROM p LEFT JOIN f ON f.id = p.id AND f.part = p.part)")


def flatten_sql():
    return (f"WITH {_conv_corpus_sql()}, {_vocab_sql(V.DEFAULT_FILTERS)}, {_encode_sql()}, "
            "m AS (SELECT max(len(ids)) AS n FROM seqs), "
            "p AS (SELECT id, list_concat(ids, list_transform(range(m.n - len(ids)), lambda x: 0::BIGINT)) AS padded FROM seqs, m), "
            "x AS (SELECT id, unnest(padded) AS wi, unnest(generate_series(0, len(padded) - 1)) AS pos FROM p), "
            f"mat AS (SELECT v.word_index, coalesce(e.embedding, {_zeros_sql()}) AS vector FROM vocab v "
            "LEFT JOIN embeddings e ON e.vec_id = v.word_index - 1) "
            f"SELECT x.id, flatten(list(coalesce(mat.vector, {_zeros_sql()}) ORDER BY x.pos)) AS flat "
            "FROM x LEFT JOIN mat ON mat.word_index = x.wi GROUP BY x.id")


def flatten_docs_sql():
    return (f"WITH docs AS (SELECT 0 AS part, doc_id AS doc, text FROM documents), {_vocab_sql(V.DEFAULT_FILTERS)}, {_pieces_sql()} "
            "SELECT id, part, list_transform(flat, lambda y: round(y::DOUBLE, 6)) AS flat, padding FROM pieces")


def split_tagged_docs(spark, sf_dir):
    c = comments(spark, sf_dir)
    test = H.split_flag(0.3)
    tags = F.when(test, G.split_tags("Test")).otherwise(G.split_tags("Train"))
    return c.select("id", X.whitespace_tokens(X.clean_emoticons("comment_text")).alias("words"), tags.alias("tags"))


def split_tagged_docs_sql():
    return with_comments(f"SELECT id, {S.tokens(S.emoticons('comment_text'))} AS words, "
                         f"[CASE WHEN {H.row_hash_sql('split')} < {int(0.3 * H.TWO_32)} THEN 'Test_' ELSE 'Train_' END || CAST(id AS VARCHAR)] AS tags FROM comments")


ATTR_BOOLS = [*SCORED_IDENTITIES, *SUBTYPE_COLUMNS, "toxicity_annotator_count", "identity_annotator_count"]


def attribute_tagged(spark, sf_dir):
    c = N.apply_rule_table(comments(spark, sf_dir))
    test = H.split_flag(0.3)
    tags = F.when(test, G.attribute_tags(ATTR_BOOLS, ["article_id"], "Test")).otherwise(
        G.attribute_tags(ATTR_BOOLS, ["article_id"], "Train"))
    return c.select("id", tags.alias("tags"))


def attribute_tagged_sql():
    rules = {c: f"coalesce({c} >= 0.5e0, false)" for c in [*SCORED_IDENTITIES, *SUBTYPE_COLUMNS]}
    rules["toxicity_annotator_count"] = "coalesce(toxicity_annotator_count >= 8.78e0, false)"
    rules["identity_annotator_count"] = "coalesce(identity_annotator_count >= 1.44e0, false)"
    vals = ", ".join(f"CASE WHEN {rules[c]} THEN 'True' ELSE 'False' END" for c in ATTR_BOOLS)
    split = f"CASE WHEN {H.row_hash_sql('split')} < {int(0.3 * H.TWO_32)} THEN 'Test_' ELSE 'Train_' END || CAST(id AS VARCHAR)"
    return with_comments(f"SELECT id, [{vals}, CAST(article_id AS VARCHAR), {split}] AS tags FROM comments")


def toxicity_tagged(spark, sf_dir):
    c = comments(spark, sf_dir)
    return c.select("id", X.whitespace_tokens(X.clean("comment_text")).alias("words"),
                    G.toxicity_tag(at_least("target", 0.5)).alias("tags"))


def toxicity_tagged_sql():
    return with_comments(f"SELECT id, {S.tokens(S.clean('comment_text'))} AS words, "
                         "[CAST(id AS VARCHAR) || '_' || CASE WHEN coalesce(target >= 0.5e0, false) THEN 'True' ELSE 'False' END] AS tags "
                         "FROM comments")


def identity_tagged(spark, sf_dir):
    return comments(spark, sf_dir).select("id", G.identity_tag().alias("tags"))


def identity_tagged_sql():
    from biasframe.schema import IDENTITY_COLUMNS
    parts = " || ".join(f"CASE WHEN coalesce({c} = 1, false) THEN '{c}_' ELSE '' END" for c in IDENTITY_COLUMNS)
    return with_comments(f"SELECT id, [CAST(id AS VARCHAR) || '_' || {parts}] AS tags FROM comments")


def two_spaces(spark, sf_dir):
    """Per word, the vector of one space followed by the other's. Space A
    maps the document vocabulary by rank, space B the conversation vocabulary."""
    a = _vectors(spark, sf_dir, doc_vocab(spark, sf_dir))
    b = _vectors(spark, sf_dir, conv_vocab(spark, sf_dir))
    return G.concat_spaces(a, b)


def two_spaces_sql():
    return (f"WITH {_doc_corpus_sql()}, {_vocab_sql(V.NEWLINE_TAB_FILTERS)}, "
            f"{_conv_corpus_sql().replace('docs AS', 'docs2 AS')}, {_vocab_sql(V.DEFAULT_FILTERS, '2')} "
            "SELECT a.word, list_concat(ea.embedding, eb.embedding) AS vector "
            "FROM vocab a JOIN embeddings ea ON ea.vec_id = a.word_index - 1 "
            "JOIN vocab2 b ON b.word = a.word JOIN embeddings eb ON eb.vec_id = b.word_index - 1")


def features_appended(spark, sf_dir):
    """The flattened word vectors of a turn, padded to the longest, followed by its
    30 features."""
    from biasframe.operators.features import append_features, feature_columns
    docs = conv_docs(spark, sf_dir)
    vocab = conv_vocab(spark, sf_dir)
    feats = F.array(*[c.cast("double") for c in feature_columns("text")])
    rows = docs.select("id", feats.alias("f"), V.tokens("text").alias("words"))  # the features stay in their row
    seqs, m = _sequences(spark, sf_dir, encode_arrays(rows, "words", vocab), vocab)
    return G.padded_vectors(seqs, m, EMBED_DIM, F.col("max_len")).select("id", append_features("flat", "f").alias("vector"))


def features_appended_sql():
    t = "coalesce(c.text, '')"
    cols = [S.punctuation_count(t)] + [S.longest_run(t, ch) for ch in X.AGGRESSIVE_PUNCTUATION]
    from biasframe.schema import IDENTITY_COLUMNS
    cols += [S.substring_count(t, name) for name in IDENTITY_COLUMNS]
    cols += ["0", S.word_count(t)]
    feats = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "]"
    base = flatten_sql()
    return (f"WITH fl AS ({base}), ft AS (SELECT conv_id * 1000 + turn AS id, {feats} AS f FROM conversations c) "
            "SELECT fl.id, list_concat(CAST(fl.flat AS DOUBLE[]), ft.f) AS vector FROM fl JOIN ft ON ft.id = fl.id")


QUERIES = {
    "g13_concat_spaces": (two_spaces, two_spaces_sql),
    "e8_append_features": (features_appended, features_appended_sql),
    "f4_vocabulary": (vocabulary, vocabulary_sql),
    "f7_vocabulary_size": (vocabulary_size, vocabulary_size_sql),
    "f8_encode": (encode_docs, encode_docs_sql),
    "f9_max_length": (max_len, max_len_sql),
    "f10_pad_post": (pad_post, pad_post_sql),
    "f11_pad_pre": (pad_pre, pad_pre_sql),
    "f11_pad_pre_documents": (pad_pre_docs, pad_pre_docs_sql),
    "f12_model_inputs": (model_inputs, model_inputs_sql),
    "f12_wordpiece_inputs": (wordpiece_inputs, wordpiece_inputs_sql),
    "f2_document_sentences": (document_sentences, document_sentences_sql),
    "f2_sentence_corpus": (sentence_corpus, sentence_corpus_sql),
    "f13_example_records": (example_records, example_records_sql),
    "g1_embedding_matrix": (matrix, matrix_sql),
    "g2_g3_coverage": (coverage, coverage_sql),
    "j11_oov_words": (oov_words, oov_words_sql),
    "g4_flatten_vectors": (flatten, flatten_sql),
    "g4_flatten_documents": (flatten_docs, flatten_docs_sql),
    "g9_split_tagged_docs": (split_tagged_docs, split_tagged_docs_sql),
    "g10_attribute_tagged_docs": (attribute_tagged, attribute_tagged_sql),
    "g11_toxicity_tagged_docs": (toxicity_tagged, toxicity_tagged_sql),
    "g12_identity_tagged_docs": (identity_tagged, identity_tagged_sql),
}
