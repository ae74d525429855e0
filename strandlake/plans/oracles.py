"""SQL for DuckDB that computes what each ready-made query computes, from the tables alone."""

from __future__ import annotations

from ..functions.alphabet import AMBIGUOUS, AMINO_ACIDS, BASES_N, IUPAC
from ..spec import LINKED_READ_SPEC, SKETCH_SPEC, HashSpec
from .inputs import CODE_FACTOR, COPY_LEVELS, PART_RANGE, SECOND_COPY

ORACLES: dict[str, str] = {}

_LOW = (1 << 32) - 1
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_LATIN_BASES = "ACGTACGTACGTACGTACGTACGTAC"
_TYPES = "['err', 'htA', 'htB', 'hom', 'mul']"


def dna(text: str) -> str:
    return (
        f"translate(lower(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{_LATIN}', '{_LATIN_BASES}')"
    )


def complement(seq: str) -> str:
    return f"translate(reverse({seq}), 'ACGTN', 'TGCAN')"


def _hash(code: str, spec: HashSpec) -> str:
    high, low = spec.factor >> 32, spec.factor & _LOW
    bottom = f"(({code} & {_LOW}) * {low})"
    top = (
        f"((({bottom} >> 32) + ((({code} & {_LOW}) * {high}) & {_LOW}) + ((({code} >> 32) * {low}) & {_LOW})) & {_LOW})"
    )
    return f"(({top} << {32 - spec.shift}) | (({bottom} & {_LOW}) >> {spec.shift}))"


def hits(source: str, name: str = "hits", spec: HashSpec = SKETCH_SPEC) -> str:
    """CTEs ending in ``name(sid, ord, pos, hash, is_fwd)`` for ``source`` = SELECT of (sid, dna).

    K-mer codes come from doubling with ``lead``: codes of 2, 4, 8, ... bases, then those that add up
    to k.
    """
    over = "OVER (PARTITION BY sid ORDER BY pos)"
    steps = [
        f"{name}_0 AS (SELECT sid, unnest(range(length(dna))) AS pos, unnest(list_transform("
        f"string_split(dna, ''), lambda c: CASE c WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END)::BIGINT[]) AS f1 "
        f"FROM ({source}) WHERE length(dna) >= {spec.k})",
        f"{name}_1 AS (SELECT *, f1 AS r1 FROM {name}_0)",
    ]
    size, last = 1, f"{name}_1"
    while size * 2 <= spec.k:
        span = 4**size
        steps.append(
            f"{name}_{2 * size} AS (SELECT *, f{size} * {span} + lead(f{size}, {size}) {over} AS f{2 * size}, "
            f"r{size} + {span} * lead(r{size}, {size}) {over} AS r{2 * size} FROM {last})"
        )
        size, last = size * 2, f"{name}_{2 * size}"
    forward, reverse, done = f"f{size}", f"r{size}", size
    while done < spec.k:
        size //= 2
        if spec.k - done >= size:
            forward = f"({forward} * {4**size} + lead(f{size}, {done}) {over})"
            reverse = f"({reverse} + {4**done} * lead(r{size}, {done}) {over})"
            done += size
    steps.append(
        f"{name}_k AS (SELECT sid, pos, {forward} AS f, {spec.mask} - {reverse} AS r FROM {last})"
    )
    steps.append(
        f"{name}_h AS (SELECT sid, pos, {_hash('f', spec)} AS hf, {_hash('r', spec)} AS hr "
        f"FROM {name}_k WHERE f IS NOT NULL)"
    )
    steps.append(
        f"{name} AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS ord, pos, "
        f"least(hf, hr) AS hash, hf < hr AS is_fwd FROM {name}_h WHERE least(hf, hr) % {spec.w} = 0)"
    )
    return ",\n".join(steps)


DOCS = f"SELECT doc_id AS sid, {dna('text')} AS dna FROM documents"
DOC_HITS = hits(DOCS)
REF_HITS = hits(f"SELECT item_id AS sid, {dna('text')} AS dna FROM benchmark", "ref")
TWICE_HITS = hits(
    f"SELECT item_id + copy AS sid, {dna('text')} AS dna FROM benchmark, (SELECT unnest([0, {SECOND_COPY}]) AS copy)", "ref"
)
COUNTS = "counts AS (SELECT hash, count(*) AS depth FROM hits GROUP BY hash)"


def copy_case(depth: str = "depth") -> str:
    one, two, multi = COPY_LEVELS
    return (
        f"CASE WHEN {depth} < {one} THEN 0 WHEN {depth} < {two} THEN 1 WHEN {depth} < {multi} THEN 2 ELSE 3 END"
    )


def add(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}" if ctes else select


CLASSED = f"{DOC_HITS},\n{COUNTS},\nclassed AS (SELECT hash, depth, {copy_case()} AS copy FROM counts)"

def _only(symbols: str) -> str:
    both = symbols + "".join(c.lower() for c in symbols if c.isalpha())
    return f"upper(regexp_replace(text, '[^{both}]', '', 'g'))"


_WRAPPED = "regexp_replace({seq}, '(.{{60}})', '\\1' || chr(10), 'g')"
# no line after the last, if that is full
_LINES = "CASE WHEN length({seq}) % 60 = 0 AND length({seq}) > 0 THEN left(" + _WRAPPED + ", -1) ELSE " + _WRAPPED + " END"
_TITLED = f"SELECT doc_id, doc_id || CASE WHEN coalesce(lang, '') = '' THEN '' ELSE ' ' || lang END AS title, {dna('text')} AS seq FROM documents"
ORACLES["fasta_texts"] = (
    f"WITH reads AS ({_TITLED}) SELECT doc_id AS read_id, '>' || title || chr(10) || {_LINES.format(seq='seq')} AS value FROM reads"
)
ORACLES["fastq_texts"] = (
    f"WITH reads AS ({_TITLED}) SELECT doc_id AS read_id, "
    "'@' || title || chr(10) || seq || chr(10) || '+' || chr(10) || translate(seq, 'ACGT', '@+I5') AS value FROM reads"
)
ORACLES["fasta_records"] = (
    "SELECT row_number() OVER (ORDER BY doc_id) AS seq_id, doc_id::VARCHAR AS name, coalesce(lang, '') AS \"desc\", "
    f"{_only('-' + IUPAC)} AS seq FROM documents"
)
ORACLES["converted_texts"] = (
    f"SELECT doc_id, {_only(BASES_N)} AS bases, {_only('-' + IUPAC)} AS ambiguous, "
    f"translate({_only('-' + IUPAC)}, '{AMBIGUOUS}', '{'N' * len(AMBIGUOUS)}') AS to_n, translate({_only(BASES_N)}, 'ACGTN', '01230') AS digits, "
    f"{_only(AMINO_ACIDS)} AS amino_acids FROM documents"
)
for _reader in ("fastq_records", "fastq_multi_line_records"):
    ORACLES[_reader] = (
        f"WITH reads AS (SELECT doc_id, lang, {dna('text')} AS seq FROM documents) "
        "SELECT row_number() OVER (ORDER BY doc_id) AS seq_id, doc_id::VARCHAR AS name, coalesce(lang, '') AS \"desc\", seq, "
        "translate(seq, 'ACGT', '@+I5') AS qual FROM reads"
    )


add("sketch_hits", DOC_HITS, "SELECT sid AS read_id, ord, pos, hash, is_fwd FROM hits")


def minimizers(w: int = SKETCH_SPEC.w, doublings: int = 17) -> tuple[str, str]:
    """CTEs and SELECT of jumping minimizers: the windows of a document that its first one leads to.

    A jump leads from the start of one window to the next; jumps of 2, 4, 8, ... steps come from joining jumps.
    """
    residue = 1 << (w - 1).bit_length()
    ctes = [
        DOC_HITS,
        "kmers AS MATERIALIZED (SELECT sid, pos, least(hf, hr) AS hash, hf < hr AS is_fwd, count(*) OVER (PARTITION BY sid) AS n FROM hits_h)",
        f"windows AS (SELECT sid, pos AS s, n, min(hash * {residue} + pos % {w}) OVER (PARTITION BY sid ORDER BY pos "
        f"ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS key FROM kmers)",
        f"nexts AS MATERIALIZED (SELECT sid, s, n, key // {residue} AS hash, s + ((key % {residue} - s) % {w} + {w}) % {w} AS v FROM windows)",
        "jump_0 AS MATERIALIZED (SELECT a.sid, a.s, b.s AS t FROM nexts a JOIN nexts b ON b.sid = a.sid AND b.s = a.v + 1 "
        f"WHERE a.s + {w} < a.n AND (b.s + {w} <= a.n OR b.hash < a.hash))",
    ]
    for i in range(1, doublings):
        ctes.append(
            f"jump_{i} AS MATERIALIZED (SELECT a.sid, a.s, b.t FROM jump_{i - 1} a JOIN jump_{i - 1} b ON b.sid = a.sid AND b.s = a.t)"
        )
    reached = "SELECT sid, s FROM nexts WHERE s = 0"
    for i in reversed(range(doublings)):
        ctes.append(f"reach_{i} AS MATERIALIZED ({reached})")
        reached = f"SELECT sid, s FROM reach_{i} UNION ALL SELECT r.sid, j.t FROM reach_{i} r JOIN jump_{i} j ON j.sid = r.sid AND j.s = r.s"
    ctes.append(f"reached AS ({reached})")
    return ",\n".join(ctes), (
        "SELECT sid AS read_id, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS ord, pos, k.hash, is_fwd "
        "FROM reached JOIN nexts USING (sid, s) JOIN kmers k USING (sid) WHERE k.pos = v"
    )


add("sketch_minimizers", *minimizers())
add("sketch_depth_histogram", f"{DOC_HITS},\n{COUNTS}", "SELECT depth, count(*) AS n FROM counts GROUP BY depth")
add(
    "sketch_totals", DOC_HITS,
    f"SELECT (SELECT count(*) FROM documents) AS n_seq, (SELECT sum(length(dna)) FROM ({DOCS})) AS total_len, "
    "(SELECT count(*) FROM hits) AS total_hash",
)
add(
    "sketch_linked_reads",
    hits(f"SELECT sid, CASE WHEN sid % 2 = 0 THEN substr(dna, 24) ELSE dna END AS dna FROM ({DOCS})") + ",\n" + COUNTS,
    "SELECT hash, depth FROM counts",
)
add("sketch_prune", f"{DOC_HITS},\n{COUNTS}", "SELECT hash, depth FROM counts WHERE depth >= 2 AND depth < 50")
add(
    "sketch_copy_classes", CLASSED,
    "SELECT hash, depth, CASE WHEN depth >= 75 THEN 3 ELSE copy END AS copy FROM classed",
)
LANGS = ("de", "en", "es", "fr")
LANG_SETS = (
    f"{DOC_HITS},\nlang_sets AS (SELECT lang, hash, count(*) AS depth, "
    f"{copy_case('count(*)')} AS copy FROM hits JOIN documents ON sid = doc_id GROUP BY lang, hash)"
)
add(
    "sketch_merge", LANG_SETS,
    "SELECT hash, sum(depth) AS depth, least(sum(copy), 3) AS copy FROM lang_sets "
    "WHERE lang IN ('en', 'fr') GROUP BY hash",
)
add(
    "sketch_merge_compat", LANG_SETS,
    "SELECT hash, sum(depth) AS depth, (least(sum(copy), 3)::INT "
    "| coalesce(max(copy) FILTER (lang = 'en'), 0)::INT) AS copy FROM lang_sets "
    "WHERE lang IN ('en', 'fr') GROUP BY hash",
)
add(
    "sketch_merge_all", LANG_SETS,
    "SELECT hash, sum(depth) AS depth, least(sum(copy), 3) AS copy FROM lang_sets GROUP BY hash",
)
add(
    "sketch_summary",
    f"{CLASSED},\nbins AS (SELECT depth, count(*) AS n FROM classed GROUP BY depth),\n"
    "run AS (SELECT depth, sum(depth * n) OVER (ORDER BY depth) AS cum, sum(depth * n) OVER () AS total FROM bins)",
    "SELECT count(*) AS n_entries, sum(depth) AS total_count, sum(depth)::DOUBLE / count(*) AS avg_depth, "
    "(SELECT min(depth) FROM run WHERE cum > total // 2) AS n50_depth, "
    + ", ".join(f"count(*) FILTER (copy = {c}) AS {n}" for c, n in enumerate(("copy0", "copy1", "copy2", "copy_multi")))
    + " FROM classed",
)
add(
    "sketch_depth_report", f"{CLASSED},\n" + LANG_SETS[len(DOC_HITS) + 2:],
    "SELECT lower(hex(c.hash)) AS hash, c.copy, c.depth, "
    + ", ".join(f"coalesce({lang}.depth, 0) AS depth_{lang}" for lang in LANGS)
    + " FROM classed c "
    + " ".join(
        f"LEFT JOIN (SELECT hash, depth FROM lang_sets WHERE lang = '{lang}') {lang} ON {lang}.hash = c.hash"
        for lang in LANGS
    )
    + " WHERE c.depth >= 2",
)

# ------------------------------------------------------------------------------ composition

add(
    "base_composition",
    "chars AS (SELECT unnest(string_split(text, '')) AS c FROM documents),\n"
    "sized AS (SELECT CASE WHEN strlen(c) = 1 AND ascii(c) BETWEEN 32 AND 126 THEN c ELSE 'unprintable' END AS base, "
    "strlen(c) AS size FROM chars),\n"
    "grouped AS (SELECT base, sum(size) AS n FROM sized WHERE size > 0 GROUP BY base)",
    "SELECT base, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM grouped",
)
add(
    "quality_composition",
    "bytes AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS digits FROM conversations),\n"
    "grouped AS (SELECT ('0x' || digits)::INT - 33 AS quality, count(*) AS n FROM bytes GROUP BY 1)",
    "SELECT quality, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS pct FROM grouped",
)
add(
    "sequence_lengths", "",
    "SELECT count(*) AS n_seq, sum(strlen(html)) AS total, avg(strlen(html)) AS average FROM pages",
)

# --------------------------------------------------------------------------------- barcodes

add(
    "good_codes", "",
    f"SELECT substr(dna, 1, 16) AS barcode, count(*) AS n FROM ({DOCS}) WHERE length(dna) >= 16 GROUP BY 1 HAVING count(*) >= 2",
)


def user_barcode(user: str) -> str:
    digits = f"lambda i: substr('ACGT', 1 + (({user} * {CODE_FACTOR} % {4**16}) // (4 ** (15 - i))::BIGINT % 4)::INT, 1)"
    return f"list_aggregate(list_transform(range(16), {digits}), 'string_agg', '')"


def overlay(text: str, base: str, at: str) -> str:
    return f"(substr({text}, 1, {at}) || {base} || substr({text}, {at} + 2))"


ORACLES["whitelist_lines"] = (
    "WITH lines AS (SELECT c_custkey, barcode FROM (SELECT c_custkey, "
    f"{user_barcode('c_custkey')} AS barcode FROM customer) UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 7 = 0), "
    "numbered AS (SELECT row_number() OVER (ORDER BY c_custkey, barcode) AS line_no, barcode FROM lines) "
    "SELECT line_no, barcode FROM numbered WHERE barcode <> ''"
)
ORACLES["fastq_fixed_length_records"] = (
    f"WITH reads AS (SELECT p_partkey, {user_barcode('p_partkey')} AS seq FROM part) "
    "SELECT row_number() OVER (ORDER BY p_partkey) AS seq_id, p_partkey::VARCHAR AS name, '' AS \"desc\", seq, "
    "translate(seq, 'ACGT', '@+I5') AS qual FROM reads"
)

EVENT_CODES = (
    f"coded AS (SELECT event_id, {user_barcode('user_id')} AS code, "
    "substr('ACGT', 1 + ((event_id // 16) % 4)::INT, 1) AS base FROM events),\n"
    f"misread AS (SELECT event_id, base, {overlay('code', 'base', '(event_id % 16)')} AS once FROM coded),\n"
    f"reads AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN {overlay('once', 'base', '((event_id + 5) % 16)')} "
    "ELSE once END AS raw FROM misread)"
)


def variants(exact_first: bool) -> str:
    first = "(raw = barcode) DESC, " if exact_first else ""
    return (
        f"white AS (SELECT c_custkey AS line_no, {user_barcode('c_custkey')} AS barcode FROM customer),\n"
        "spots AS (SELECT line_no, barcode, unnest(range(16)) AS spot FROM white),\n"
        "changes AS (SELECT *, unnest(['A', 'C', 'G', 'T']) AS base FROM spots),\n"
        f"near AS (SELECT {overlay('barcode', 'base', 'spot')} AS raw, * FROM changes),\n"
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY {first}line_no DESC, spot DESC) AS r FROM near),\n"
        "variants AS (SELECT raw, barcode, CASE WHEN raw <> barcode THEN spot END AS fix_pos FROM ranked WHERE r = 1)"
    )


for _name, _exact in (("corrected_barcodes", True), ("corrected_barcodes_latest", False)):
    add(_name, f"{EVENT_CODES},\n{variants(_exact)}", "SELECT event_id, barcode, fix_pos FROM reads JOIN variants USING (raw)")
add(
    "barcode_correction_counts", f"{EVENT_CODES},\n{variants(True)},\n"
    "found AS (SELECT event_id, barcode, fix_pos FROM reads LEFT JOIN variants USING (raw))",
    "SELECT count(barcode) AS n_written, count(*) - count(barcode) AS n_dropped, count(fix_pos) AS n_fixed, "
    + ", ".join(f"count(*) FILTER (fix_pos = {i}) AS fixed_{i}" for i in range(16))
    + ", round((count(*) - count(barcode)) * 100.0::DOUBLE / count(*), 6) AS pct_dropped, "
    "round(count(fix_pos) * 100.0::DOUBLE / count(barcode), 6) AS pct_fixed FROM found",
)
add(
    "paired_mates", "",
    f"SELECT doc_id AS seq_id, lang <> CASE WHEN lang = 'en' THEN 'en' ELSE source END AS names_differ, "
    f"length({dna('text')}) AS len1, md5({complement(dna('text'))}) AS seq2_md5 FROM documents",
)


def packed(text: str, per_word: int, n_words: int, base: int, value: str) -> str:
    """Hex digits of little-endian words; ``value`` maps a character ``c`` to its digit."""
    number = (
        f"list_sum(list_transform(range({per_word}), lambda j: CASE WHEN i * {per_word} + j < length({text}) THEN "
        f"list_extract(list_transform([substr({text}, (i * {per_word} + j + 1)::INT, 1)], lambda c: {value}), 1) * "
        f"({base} ** ({per_word - 1} - j))::BIGINT ELSE 0 END))::BIGINT"
    )
    byte = "lambda b: lpad(hex((w >> (8 * b)) & 255), 2, '0')"
    word = f"lambda w: list_aggregate(list_transform([0, 1, 2, 3], {byte}), 'string_agg', '')"
    return (
        f"list_aggregate(list_transform(list_transform(range({n_words}), lambda i: {number}), {word}), 'string_agg', '')"
    )


_BASE = "CASE c WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END"
_QUAL = "CASE WHEN ascii(c) >= 56 THEN 1 ELSE 0 END"
PART_PAIRS = (
    "named AS (SELECT p_partkey, p_name || p_brand || p_type AS t FROM part),\n"
    f"mates AS (SELECT p_partkey, {dna('t')} AS seq1, t AS qual1, {complement(dna('t'))} AS seq2, reverse(t) AS qual2 FROM named)"
)
add(
    "packed_records", PART_PAIRS,
    "SELECT p_partkey, "
    + " || ".join(
        packed(f"{kind}{mate}", *shape)
        for mate in (1, 2)
        for kind, shape in (("seq", (16, 10, 4, _BASE)), ("qual", (32, 5, 2, _QUAL)))
    )
    + " AS record FROM mates",
)


def _bits(qual: str) -> str:
    return f"rpad(regexp_replace(regexp_replace({qual}, '[^8-~]', '0', 'g'), '[8-~]', '1', 'g'), 160, '0')"


add(
    "unpacked_records", PART_PAIRS,
    "SELECT p_partkey, list_sum(list_transform(range(16), lambda j: "
    "(strpos('ACGT', substr(rpad(seq1, 160, 'A'), (j + 1)::INT, 1)) - 1) * (4 ** (15 - j))::BIGINT))::BIGINT AS barcode, "
    f"rpad(seq1, 160, 'A') AS seq1, {_bits('qual1')} AS qual1, rpad(seq2, 160, 'A') AS seq2, {_bits('qual2')} AS qual2 FROM mates",
)
CONV = f"SELECT conv_id AS barcode, turn AS read, {dna('text')} AS seq FROM conversations"
MATES = (
    "SELECT row_number() OVER () AS sid, barcode, read, dna FROM ("
    f"SELECT barcode, read, substr(seq, 24) AS dna FROM ({CONV}) "
    f"UNION ALL SELECT barcode, read, {complement('seq')} FROM ({CONV}))"
)
add(
    "linked_read_incidence",
    f"mates AS MATERIALIZED ({MATES}),\n" + hits("SELECT sid, dna FROM mates", spec=LINKED_READ_SPEC),
    "SELECT barcode, hash, min(read) AS read FROM hits JOIN mates USING (sid) GROUP BY barcode, hash",
)

# -------------------------------------------------------------------------------- incidence


def incidence(barcode: str, hash_column: str, read: str) -> str:
    return (
        f"inc AS (SELECT {barcode} AS barcode, {hash_column} AS hash, min({read}) AS read FROM lineitem GROUP BY 1, 2),\n"
        "depths AS (SELECT hash, count(*) AS depth FROM inc GROUP BY hash),\n"
        "codes AS (SELECT barcode, count(DISTINCT read) AS n_read, count(*) AS n_hash FROM inc GROUP BY barcode)"
    )


ORDERS = incidence("l_orderkey", "l_partkey", "l_linenumber")
SUPPLIERS = incidence("l_suppkey", "l_partkey", "l_orderkey")
ORDER_SUPPLIERS = incidence("l_orderkey", "l_suppkey", "l_linenumber")
RANGED = f"ranged AS (SELECT hash FROM depths WHERE depth >= {PART_RANGE[0]} AND depth < {PART_RANGE[1]})"

add("barcode_hashes", ORDERS, "SELECT barcode, hash, read FROM inc")
add(
    "barcode_totals", ORDERS,
    "SELECT sum(n_read) AS n_reads, count(*) AS n_barcodes, sum(n_hash) AS n_hashes, "
    "sum(n_read)::DOUBLE / count(*) AS reads_per_barcode, sum(n_hash)::DOUBLE / sum(n_read) AS hashes_per_read, "
    "sum(n_hash)::DOUBLE / count(*) AS hashes_per_barcode FROM codes",
)
add(
    "inverse_totals", ORDERS,
    "SELECT count(*) AS n_hashes, count(DISTINCT barcode) AS n_barcodes, count(DISTINCT hash) AS n_bins FROM inc",
)
add(
    "inverse_lists", f"{SUPPLIERS},\n{RANGED}",
    "SELECT hash, count(*) AS depth, string_agg(barcode::VARCHAR, ' ' ORDER BY barcode) AS barcodes FROM inc "
    "WHERE hash IN (SELECT hash FROM ranged) GROUP BY hash",
)
add(
    "hash_ids", ORDERS,
    "SELECT hash, row_number() OVER (ORDER BY min(barcode), hash) AS hash_id FROM inc GROUP BY hash",
)


def histogram_stats(source: str, skip_zero: bool = False) -> tuple[str, str]:
    """CTEs and SELECT of the percentile summary of ``source`` = SELECT of (bin)."""
    skip = " AND bin > 0" if skip_zero else ""
    ctes = (
        f"hist AS (SELECT bin, count(*) AS n FROM ({source}) GROUP BY bin),\n"
        "run AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS cn, sum(bin * n) OVER (ORDER BY bin) AS cm, "
        "sum(n) OVER () AS tn, sum(bin * n) OVER () AS tm FROM hist)"
    )

    def past(running: str, total: str, share: float) -> str:
        return f"(SELECT min(bin) FROM run WHERE {running} > floor({total} * {share}::DOUBLE){skip})"

    select = (
        "SELECT (SELECT sum(n) FROM hist) AS total_n, (SELECT sum(bin * n) FROM hist) AS total_mass, "
        "(SELECT sum(bin * n)::DOUBLE / sum(n) FROM hist) AS mean, "
        "(SELECT bin FROM hist ORDER BY n DESC, bin LIMIT 1) AS mode, "
        f"{past('cn', 'tn', 0.5)} AS median, {past('cn', 'tn', 0.99)} AS percent99, "
        "(SELECT bin FROM hist ORDER BY bin * n DESC, bin LIMIT 1) AS mass_mode, "
        f"{past('cm', 'tm', 0.5)} AS n50, {past('cm', 'tm', 0.99)} AS n99"
    )
    return ctes, select


_ctes, _select = histogram_stats("SELECT depth AS bin FROM depths")
add("hash_depth_stats", f"{ORDERS},\n{_ctes}", _select)
_ctes, _select = histogram_stats("SELECT n_hash AS bin FROM codes", skip_zero=True)
add("code_size_stats", f"{ORDERS},\n{_ctes}", _select)
add(
    "hash_depth_histogram",
    f"{ORDERS},\nhist AS (SELECT depth AS bin, count(*) AS n FROM depths GROUP BY depth)",
    "SELECT bin, n, round(sum(n) OVER (ORDER BY bin)::DOUBLE / sum(n) OVER (), 6) AS cum_frac, "
    "round(sum(bin * n) OVER (ORDER BY bin)::DOUBLE / sum(bin * n) OVER (), 6) AS cum_mass_frac FROM hist",
)


def neighbours(targets: str) -> str:
    return (
        f"targets AS ({targets}),\n"
        "near AS (SELECT a.hash AS x, b.hash AS hash, count(*) AS share FROM inc a JOIN inc b USING (barcode) "
        "WHERE a.hash IN (SELECT x FROM targets) AND a.hash <> b.hash AND b.hash IN (SELECT hash FROM ranged) GROUP BY 1, 2)"
    )


def deepest(n: int) -> str:
    return f"SELECT hash AS x FROM depths ORDER BY depth DESC, hash LIMIT {n}"


add("hash_neighbours", f"{SUPPLIERS},\n{RANGED},\n{neighbours(deepest(1))}", "SELECT x, hash, share FROM near")
add(
    "hash_explore", f"{SUPPLIERS},\n{RANGED},\n{neighbours(deepest(1))},\n"
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY x, share ORDER BY hash DESC) AS r FROM near)",
    "SELECT x, share, count(*) AS n, string_agg(hash::VARCHAR, ' ' ORDER BY hash) FILTER (r <= 7) AS sample_hashes "
    "FROM ranked GROUP BY x, share",
)
add(
    "hash_double_shared", f"{SUPPLIERS},\n{RANGED},\n{neighbours(deepest(2))},\n"
    "named AS (SELECT hash AS x, row_number() OVER (ORDER BY depth DESC, hash) AS r FROM depths)",
    "SELECT a.hash, (SELECT min(barcode) FROM inc WHERE inc.hash = a.hash) AS first_barcode, a.share AS n1, b.share AS n2 "
    "FROM near a JOIN near b ON a.hash = b.hash WHERE a.x = (SELECT x FROM named WHERE r = 1) "
    "AND b.x = (SELECT x FROM named WHERE r = 2) AND a.share > 2 AND b.share > 2",
)
add(
    "hash_info", f"{SUPPLIERS},\n{RANGED},\n"
    + neighbours("SELECT hash AS x FROM ranged WHERE hash % 100 = 0")
    + ",\nbest AS (SELECT x, hash, share, row_number() OVER (PARTITION BY x ORDER BY share DESC, hash DESC) AS r FROM near)",
    "SELECT d.hash AS x, d.depth, b.share AS max_share, b.hash AS best_hash FROM depths d "
    "LEFT JOIN best b ON b.x = d.hash AND b.r = 1 WHERE d.hash % 100 = 0",
)
TOPLESS = (
    "shares AS (SELECT x, share, count(*) AS n FROM near GROUP BY x, share),\n"
    "topless AS (SELECT * FROM (SELECT x, share, CASE WHEN share = max(share) OVER (PARTITION BY x) THEN n - 1 ELSE n END AS n "
    "FROM shares) WHERE n > 0)"
)
add(
    "share_scan", f"{SUPPLIERS},\n{RANGED},\n"
    "picked AS (SELECT hash AS x, depth, row_number() OVER (PARTITION BY depth ORDER BY hash) AS r FROM depths "
    "WHERE depth >= 20 AND depth < 40 AND hash >= 40 AND (hash - 40) % 100 = 0),\n"
    + neighbours("SELECT x, depth FROM picked WHERE r <= 10") + f",\n{TOPLESS}",
    "SELECT depth, x, share, n FROM topless JOIN targets USING (x)",
)
SCORES = (
    f"{ORDER_SUPPLIERS},\n"
    "running AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS up_to, sum(count(*)) OVER () AS total FROM depths GROUP BY depth),\n"
    "middle AS (SELECT min(depth) AS median FROM running WHERE up_to > floor(total * 0.5)),\n"
    "ranged AS (SELECT hash FROM depths, middle WHERE depth >= (median + 1) // 2 AND depth <= 2 * median),\n"
    f"{neighbours('SELECT hash AS x FROM depths')},\n{TOPLESS},\n"
    "folded AS (SELECT x, max(share) AS max_share, sum(n) AS n, "
    "sum(CASE WHEN share > 3 THEN n * (share - 3) * (share - 3) ELSE 0 END) AS weight FROM topless GROUP BY x),\n"
    "scored AS (SELECT d.hash AS x, d.depth, max_share, CASE WHEN d.depth >= 5 AND max_share > 3 THEN "
    "weight / (n * (d.depth - 3))::DOUBLE END AS score FROM depths d LEFT JOIN folded f ON f.x = d.hash),\n"
    f"typed AS (SELECT scored.*, ({_TYPES})[s_nationkey % 5 + 1] AS type FROM scored JOIN supplier ON s_suppkey = x)"
)
add(
    "error_scores", SCORES,
    "SELECT x, depth, max_share, round(score, 6) AS score, type, coalesce(CASE WHEN type = 'err' THEN score > 0.00005 "
    "ELSE score < 0.00005 END, false) AS flagged FROM typed",
)
add(
    "error_score_summary", SCORES,
    "SELECT type, count(*) - count(score) AS low, count(score) AS n, round(coalesce(min(score), 1.0), 6) AS min_score, "
    "round(coalesce(avg(score), 0.0), 6) AS mean_score, round(coalesce(max(score), 0.0), 6) AS max_score, "
    "count(*) FILTER (x NOT IN (SELECT hash FROM ranged)) AS outside FROM typed GROUP BY type",
)

# ------------------------------------------------------------------------------------ truth

CRIB = (
    f"{DOC_HITS},\n{COUNTS},\n"
    "placed AS (SELECT hash, lang, doc_id + 1 AS chr, pos FROM hits JOIN documents ON sid = doc_id),\n"
    "g AS (SELECT hash, lang, count(*) AS n, min(chr) AS chr, min_by(pos, (chr, pos)) AS pos FROM placed "
    "WHERE lang IN ('en', 'de') GROUP BY hash, lang),\n"
    "joined AS (SELECT c.hash, c.depth, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, a.chr AS ca, b.chr AS cb, "
    "a.pos AS pa, b.pos AS pb FROM counts c LEFT JOIN (FROM g WHERE lang = 'en') a ON a.hash = c.hash "
    "LEFT JOIN (FROM g WHERE lang = 'de') b ON b.hash = c.hash),\n"
    "typed AS (SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 'err' WHEN na = 1 AND nb = 1 THEN 'hom' "
    "WHEN na > 1 OR nb > 1 THEN 'mul' WHEN na = 1 THEN 'htA' ELSE 'htB' END AS type FROM joined),\n"
    "crib AS (SELECT hash, depth, type, CASE type WHEN 'err' THEN 0 WHEN 'mul' THEN 1 - greatest(na, nb) "
    "WHEN 'htB' THEN cb ELSE ca END AS chr, coalesce(CASE type WHEN 'htB' THEN pb ELSE pa END >> 10, 0) AS pos FROM typed)"
)
add("crib_classes", CRIB, "SELECT hash, depth, type, chr, pos FROM crib")
add(
    "crib_labels", CRIB,
    "SELECT hash, hash || ':' || type || CASE WHEN type IN ('htA', 'htB', 'hom') THEN '_' || chr || '.' || pos ELSE '' END "
    "|| '-' || depth AS label FROM crib",
)
add(
    "crib_table", CRIB,
    "SELECT depth, count(*) FILTER (type = 'err') AS err, count(*) FILTER (type IN ('htA', 'htB')) AS het, "
    "count(*) FILTER (type = 'hom') AS hom, count(*) FILTER (type = 'mul') AS mul FROM crib GROUP BY depth",
)
add(
    "crib_stats", CRIB,
    "SELECT CASE WHEN type IN ('htA', 'htB') THEN 'het' ELSE type END AS class, count(*) AS n, "
    "round(avg(depth), 6) AS mean_depth, min(depth) AS min_depth, max(depth) AS max_depth FROM crib GROUP BY 1",
)
add(
    "crib_presence", f"{DOC_HITS},\n{COUNTS}",
    "SELECT count(*) FILTER (depth >= 2) AS n_present, count(*) FILTER (depth < 2) AS n_absent, "
    "count(DISTINCT sid) AS n_seq FROM hits JOIN counts USING (hash) JOIN documents ON doc_id = sid WHERE lang = 'en'",
)

# --------------------------------------------------------------------------------- clusters


def clusters(start: int = 1, only: str = "true") -> str:
    """CTEs ending in ``labels(barcode, hash, read, depth, i, raw, sub, share)``."""
    return (
        f"{SUPPLIERS},\n{RANGED},\n"
        "good_all AS (SELECT barcode, hash, read, depth, row_number() OVER (PARTITION BY barcode ORDER BY depth, hash) - 1 AS i "
        "FROM inc JOIN depths USING (hash) WHERE hash IN (SELECT hash FROM ranged)),\n"
        f"good AS (SELECT * FROM good_all WHERE {only}),\n"
        "pairs AS (SELECT g.barcode, o.barcode AS other, g.i FROM good g JOIN inc o ON o.hash = g.hash "
        f"AND o.barcode <> g.barcode WHERE g.i >= {start}),\n"
        "met AS (SELECT barcode, other, min(i) AS ms FROM pairs GROUP BY barcode, other),\n"
        "tally AS (SELECT barcode, i, ms, count(*) AS n FROM pairs JOIN met USING (barcode, other) GROUP BY barcode, i, ms),\n"
        "best AS (SELECT barcode, i, max(n) AS best_n, arg_min(ms, (-n, ms)) AS best, sum(n) AS met FROM tally WHERE ms < i "
        "GROUP BY barcode, i),\n"
        "joins AS (SELECT * FROM best WHERE best_n >= 5),\n"
        "chain AS (SELECT barcode, i, best AS root FROM joins j WHERE NOT EXISTS (SELECT 1 FROM joins p "
        "WHERE p.barcode = j.barcode AND p.i = j.best) UNION ALL SELECT j.barcode, j.i, c.root FROM joins j "
        "JOIN chain c ON c.barcode = j.barcode AND c.i = j.best),\n"
        "roots AS (SELECT barcode, root, row_number() OVER (PARTITION BY barcode ORDER BY min(i)) AS raw "
        "FROM (SELECT j.barcode, j.i, j.best AS root FROM joins j "
        "JOIN chain c ON c.barcode = j.barcode AND c.i = j.i AND c.root = j.best) GROUP BY barcode, root),\n"
        "member AS (SELECT barcode, i, root FROM chain UNION SELECT barcode, root, root FROM roots),\n"
        "raws AS (SELECT m.barcode, m.i, raw FROM member m JOIN roots USING (barcode, root)),\n"
        "marked AS (SELECT g.*, coalesce(r.raw, 0) AS raw FROM good g LEFT JOIN raws r USING (barcode, i)),\n"
        "edges AS (SELECT DISTINCT a.barcode, a.raw AS a, b.raw AS b FROM marked a JOIN marked b ON a.barcode = b.barcode "
        "AND a.read = b.read WHERE a.raw > 0 AND b.raw > 0),\n"
        "reach AS (SELECT barcode, a, b FROM edges UNION SELECT r.barcode, r.a, e.b FROM reach r JOIN edges e "
        "ON e.barcode = r.barcode AND e.a = r.b),\n"
        "heads AS (SELECT barcode, a AS raw, min(b) AS head FROM reach GROUP BY barcode, a),\n"
        "subs AS (SELECT barcode, raw, dense_rank() OVER (PARTITION BY barcode ORDER BY head) AS sub FROM heads),\n"
        "labels AS (SELECT m.*, coalesce(s.sub, 0) AS sub, CASE WHEN j.i IS NULL THEN 0 ELSE coalesce(t.n, 0) / j.met::DOUBLE END AS share "
        "FROM marked m LEFT JOIN subs s USING (barcode, raw) LEFT JOIN joins j USING (barcode, i) "
        "LEFT JOIN chain c USING (barcode, i) LEFT JOIN tally t ON t.barcode = m.barcode AND t.i = m.i AND t.ms = c.root)"
    )


CLUSTERS = clusters()
PART_CRIB = (
    f"crib AS (SELECT p_partkey AS hash, ({_TYPES})[p_size % 5 + 1] AS type, p_size % 7 + 1 AS chr, p_partkey % 100 AS pos FROM part)"
)
add("cluster_labels", CLUSTERS, "SELECT barcode, hash, i, raw, sub FROM labels", recursive=True)
add(
    "cluster_codes", CLUSTERS,
    "SELECT barcode, count(*) AS n_good, max(sub) AS n_sub, round(sum(share), 6) AS point_to_min FROM labels GROUP BY barcode",
    recursive=True,
)
add(
    "cluster_code_summary", CLUSTERS,
    "SELECT c.barcode, c.n_read, c.n_hash, count(l.hash) AS n_good, count(*) FILTER (l.sub > 0) AS n_clus_hash, "
    "count(DISTINCT CASE WHEN l.sub > 0 THEN l.read END) AS n_clus_read, coalesce(max(l.sub), 0) AS n_sub "
    "FROM codes c LEFT JOIN labels l USING (barcode) GROUP BY ALL",
    recursive=True,
)
_ctes, _select = histogram_stats("SELECT max(sub) AS bin FROM labels GROUP BY barcode")
add("cluster_sizes", f"{CLUSTERS},\n{_ctes}", _select, recursive=True)
add(
    "cluster_point_density", CLUSTERS,
    "SELECT round(sum(share) / count(*), 6) AS min_point_density FROM labels", recursive=True,
)
add(
    "cluster_report", f"{CLUSTERS},\n{PART_CRIB},\n"
    "typed AS (SELECT l.barcode, l.sub, l.read, l.hash, type, chr, pos FROM labels l JOIN crib USING (hash) WHERE sub > 0),\n"
    "placed AS (SELECT * FROM typed WHERE type IN ('htA', 'htB', 'hom')),\n"
    "home AS (SELECT barcode, sub, arg_min(chr, hash) AS home FROM placed GROUP BY barcode, sub),\n"
    "spans AS (SELECT barcode, sub, home, min(pos) FILTER (chr = home) AS lo, max(pos) FILTER (chr = home) AS hi, "
    "count(*) FILTER (chr <> home) AS n_other FROM placed JOIN home USING (barcode, sub) GROUP BY ALL),\n"
    "strays AS (SELECT barcode, sub, hash, row_number() OVER (PARTITION BY barcode, sub ORDER BY hash DESC) AS r "
    "FROM placed JOIN home USING (barcode, sub) WHERE chr <> home),\n"
    "listed AS (SELECT barcode, sub, string_agg(hash::VARCHAR, ' ' ORDER BY hash DESC) AS others FROM strays WHERE r <= 10 GROUP BY barcode, sub),\n"
    "counted AS (SELECT barcode, sub, count(DISTINCT read) AS n_read, count(*) AS n_hash, "
    + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in ("hom", "htA", "htB", "mul", "err"))
    + " FROM typed GROUP BY barcode, sub)",
    "SELECT c.*, s.home AS chr, s.lo, s.hi - s.lo + 1 AS span, coalesce(s.n_other, 0) AS n_other, l.others FROM counted c "
    "LEFT JOIN spans s USING (barcode, sub) LEFT JOIN listed l USING (barcode, sub)",
    recursive=True,
)
SPLIT = (
    f"{CLUSTERS},\n"
    "widths AS (SELECT c.barcode, coalesce(max(l.sub), 0) AS n_sub FROM codes c LEFT JOIN labels l USING (barcode) GROUP BY c.barcode),\n"
    "bases AS (SELECT barcode, (SELECT max(barcode) FROM codes) + coalesce(sum(n_sub) OVER (ORDER BY barcode "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM widths),\n"
    "moved AS (SELECT base + l.sub AS barcode, l.hash, l.read, l.barcode AS parent FROM labels l JOIN bases USING (barcode) WHERE l.sub > 0),\n"
    "seen AS (SELECT barcode, read, row_number() OVER (PARTITION BY barcode ORDER BY min(hash), read) - 1 AS new_read FROM moved "
    "GROUP BY barcode, read),\n"
    "stay AS (SELECT i.* FROM inc i ANTI JOIN (SELECT * FROM labels WHERE sub > 0) l ON l.barcode = i.barcode AND l.hash = i.hash),\n"
    "split_rows AS (SELECT barcode, hash, read FROM stay UNION ALL SELECT m.barcode, m.hash, new_read FROM moved m JOIN seen USING (barcode, read)),\n"
    "split_codes AS (SELECT c.barcode, c.n_read, (SELECT count(*) FROM stay s WHERE s.barcode = c.barcode) AS n_hash, NULL::BIGINT AS parent FROM codes c "
    "UNION ALL SELECT barcode, count(DISTINCT read), count(*), max(parent) FROM moved GROUP BY barcode)"
)
add("cluster_split", SPLIT, "SELECT barcode, hash, read FROM split_rows", recursive=True)
add("cluster_split_codes", SPLIT, "SELECT barcode, n_read, n_hash, parent FROM split_codes", recursive=True)
add(
    "crib_summary", f"{SPLIT},\n{PART_CRIB}",
    "SELECT c.parent IS NOT NULL AS is_cluster, type, count(*) AS n_rows, count(DISTINCT hash) AS n_hash, "
    "round(count(*)::DOUBLE / count(DISTINCT hash), 6) AS ratio FROM split_rows r JOIN split_codes c USING (barcode) "
    "JOIN crib USING (hash) GROUP BY 1, 2",
    recursive=True,
)
LARGEST = "barcode = (SELECT barcode FROM codes ORDER BY n_hash DESC, barcode LIMIT 1)"
EXPLORED = clusters(0, LARGEST)
SHARED = (
    f"{EXPLORED},\nshared AS (SELECT o.barcode, count(*) AS shared, min(g.i) AS min_share, arg_min(g.hash, g.i) AS min_hash "
    "FROM good g JOIN inc o ON o.hash = g.hash AND o.barcode <> g.barcode GROUP BY o.barcode)"
)
add("explore_code_clusters", EXPLORED, "SELECT barcode, hash, i, raw, sub FROM labels", recursive=True)
add(
    "explore_code_share", f"{SHARED},\n{PART_CRIB}",
    'SELECT s.barcode, s.shared, count(*) FILTER (type = \'htA\') AS "n_htA", count(*) FILTER (type = \'htB\') AS "n_htB", '
    "s.min_share, s.min_hash FROM shared s JOIN inc USING (barcode) JOIN crib ON crib.hash = inc.hash WHERE s.shared >= 5 GROUP BY ALL",
    recursive=True,
)
add(
    "explore_code_histogram", SHARED,
    "SELECT coalesce(shared, 0) AS bin, count(*) AS n FROM codes LEFT JOIN shared USING (barcode) GROUP BY 1", recursive=True,
)

# ---------------------------------------------------------------------------------- mapping

INDEX = (
    f"{REF_HITS},\nidx AS (SELECT hash, least(count(*), 3) AS copy, min((sid, ord, pos)) AS p1, max((sid, ord, pos)) AS p2 FROM ref GROUP BY hash)"
)
PLACES = (
    "places AS (SELECT hash, copy, p1[1] AS r1, p1[2] AS o1, p1[3] AS f1, p2[1] AS r2, p2[2] AS o2, p2[3] AS f2 FROM idx)"
)
SEEDS = (
    f"{INDEX},\n{PLACES},\n{DOC_HITS},\n"
    "seeds AS (SELECT sid AS query_id, ord AS i, pos, hits.hash, copy, r1, o1, f1, r2, o2, f2 FROM hits LEFT JOIN places USING (hash)),\n"
    "summary AS (SELECT d.sid AS query_id, length(d.dna) AS len, count(s.i) - count(copy) AS miss, count(*) FILTER (copy = 1) AS copy1, "
    "count(*) FILTER (copy = 2) AS copy2, count(*) FILTER (copy = 3) AS multi, count(s.i) AS n_seed "
    f"FROM ({DOCS}) d LEFT JOIN seeds s ON s.query_id = d.sid GROUP BY d.sid, d.dna)"
)
add(
    "reference_index", f"{INDEX},\n{PLACES}",
    "SELECT hash, copy, r1 AS ref1, f1 AS off1, r2 AS ref2, f2 AS off2 FROM places",
)
add(
    "reference_hits_in_pieces", hits(f"SELECT page_id AS sid, {dna('html')} AS dna FROM pages", "page_hits"),
    "SELECT sid AS ref_id, ord AS ref_ord, hash, pos AS \"offset\" FROM page_hits",
)
add(
    "reference_summary", INDEX,
    "SELECT count(*) FILTER (copy = 1) AS n_copy1, count(*) FILTER (copy = 2) AS n_copy2, count(*) FILTER (copy = 3) AS n_multi, "
    "(SELECT count(*) FROM ref) AS n_hits, (SELECT count(*) FROM benchmark) AS n_refs, "
    f"(SELECT sum(length({dna('text')})) FROM benchmark) AS total_len FROM idx",
)
add(
    "query_summary", SEEDS,
    "SELECT query_id, len, miss, copy1, copy2, multi, CASE WHEN n_seed > 0 THEN round((n_seed - miss)::DOUBLE / n_seed, 6) END AS hit_frac FROM summary",
)
add(
    "query_seed_places", SEEDS,
    "SELECT query_id, pos, copy, r1 AS ref1, f1 AS off1, CASE WHEN copy = 2 THEN r2 END AS ref2, CASE WHEN copy = 2 THEN f2 END AS off2 "
    "FROM seeds WHERE copy < 3",
)


def _accepts(ref: str, ordinal: str) -> str:
    return (
        f"(c.ref = {ref} AND (c.o9 = c.o0 OR (abs(abs(c.o9 - c.o0) - (c.i9 - c.i0)) <= 50 "
        f"AND ({ordinal} - c.o9) * sign(c.o9 - c.o0) >= 0)))"
    )


CHAINS = (
    f"{SEEDS},\n"
    "usable AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM seeds WHERE copy < 3),\n"
    "walk AS (SELECT query_id, r, 1 AS chain, i AS i0, pos AS q0, r1 AS ref, o1 AS o0, f1 AS f0, i AS i9, pos AS q9, o1 AS o9, f1 AS f9, "
    "(copy = 1)::INT AS n1, (copy = 2)::INT AS n2 FROM usable WHERE r = 1 UNION ALL "
    "SELECT query_id, r, chain + (NOT goes)::INT, CASE WHEN goes THEN i0 ELSE i END, CASE WHEN goes THEN q0 ELSE pos END, "
    "pr, CASE WHEN goes THEN o0 ELSE po END, CASE WHEN goes THEN f0 ELSE pf END, i, pos, po, pf, "
    "CASE WHEN goes THEN n1 ELSE 0 END + (copy = 1)::INT, CASE WHEN goes THEN n2 ELSE 0 END + (copy = 2)::INT FROM ("
    "SELECT c.query_id, u.r, c.chain, c.i0, c.q0, c.o0, c.f0, c.n1, c.n2, u.i, u.pos, u.copy, "
    f"({_accepts('u.r1', 'u.o1')} OR (u.copy = 2 AND {_accepts('u.r2', 'u.o2')})) AS goes, "
    + ", ".join(
        f"CASE WHEN {_accepts('u.r1', 'u.o1')} OR u.copy = 1 THEN u.{p}1 ELSE u.{p}2 END AS p{p}" for p in "rof"
    )
    + " FROM walk c JOIN usable u ON u.query_id = c.query_id AND u.r = c.r + 1)),\n"
    "ends AS (SELECT *, row_number() OVER (PARTITION BY query_id, chain ORDER BY r DESC) AS back FROM walk),\n"
    "judged AS (SELECT *, chain = max(chain) OVER (PARTITION BY query_id) AS is_last FROM ends WHERE back = 1)"
)
for _name, _support in (("query_chains", "n1"), ("query_chains_compat", "CASE WHEN is_last THEN n2 ELSE n1 END")):
    add(
        _name, CHAINS if _name == "query_chains" else CHAINS.replace(REF_HITS, TWICE_HITS),
        "SELECT e.query_id, q0 AS q_start, q9 AS q_end, len, ref AS ref_id, f0 AS ref_start, f9 AS ref_end, n1, n2, "
        "round((n1 + n2)::DOUBLE / nullif(abs(o9 - o0), 0), 6) AS density, round(n1::DOUBLE / nullif(copy1, 0), 6) AS copy1_frac "
        f"FROM judged e JOIN summary s ON s.query_id = e.query_id WHERE {_support} > 2",
        recursive=True,
    )

# --------------------------------------------------------------------------------- overlaps

READS = (
    f"{CLASSED},\n"
    "kept AS (SELECT * FROM classed),\n"
    "every AS (SELECT sid AS read_id, ord, pos, hash, is_fwd, copy FROM hits LEFT JOIN kept USING (hash)),\n"
    "rh AS (SELECT * FROM every WHERE copy IS NOT NULL),\n"
    "single AS (SELECT * FROM rh WHERE copy = 1),\n"
    "firsts AS (SELECT read_id, hash, min((ord, pos, is_fwd)) AS head, count(*) AS n FROM single GROUP BY read_id, hash),\n"
    "shared AS (SELECT f.read_id AS x, s.read_id AS y, head[1] AS x_ord, head[2] AS x_pos, s.ord AS y_ord, s.pos AS y_pos, "
    "head[3] = s.is_fwd AS same FROM firsts f JOIN single s USING (hash)),\n"
    "stepped AS (SELECT *, x_ord - lag(x_ord) OVER (PARTITION BY x, y ORDER BY y_ord) AS step FROM shared),\n"
    "summed AS (SELECT x, y, count(*) AS n_hit, count(*) FILTER (same) AS k, count(*) FILTER (step < 0) AS drops, "
    "count(*) FILTER (step > 0) AS rises, sum(x_pos - y_pos) AS p1, sum((x_pos - y_pos)::DOUBLE ** 2) AS p2, "
    "sum(x_pos + y_pos) AS m1, sum((x_pos + y_pos)::DOUBLE ** 2) AS m2 FROM stepped GROUP BY x, y HAVING count(*) >= 3),\n"
    "moments AS (SELECT *, CASE WHEN k = n_hit THEN p1 WHEN k = 0 THEN m1 ELSE 0 END / n_hit::DOUBLE AS mean, "
    "CASE WHEN k = n_hit THEN p2 WHEN k = 0 THEN m2 ELSE 0 END / n_hit AS square FROM summed),\n"
    "pairs AS (SELECT x, y, n_hit, CASE WHEN k = n_hit THEN n_hit - drops ELSE k END AS n_plus, "
    "CASE WHEN k = 0 THEN n_hit - rises ELSE n_hit - k END AS n_minus, mean AS mean_offset, "
    "sqrt(greatest(square - mean * mean, 0)) AS sd, trunc(mean)::BIGINT AS \"offset\", k = n_hit AS is_plus, "
    "CASE WHEN k = n_hit THEN drops > 0 WHEN k = 0 THEN rises > 0 ELSE true END AS is_bad FROM moments),\n"
    "repeats AS (SELECT read_id, sum(n - 1) AS n_repeat FROM firsts GROUP BY read_id),\n"
    "table_ AS (SELECT d.sid AS read_id, length(d.dna) AS len, count(h.copy) AS n_hit, count(h.ord) - count(h.copy) AS n_miss, "
    + ", ".join(f"count(*) FILTER (h.copy = {c}) AS n_copy{c}" for c in range(4))
    + f" FROM ({DOCS}) d LEFT JOIN every h ON h.read_id = d.sid GROUP BY d.sid, d.dna)"
)
add("read_counts", READS, "SELECT * FROM table_")
add(
    "read_overlaps", READS,
    'SELECT x, y, n_hit, n_plus, n_minus, round(mean_offset, 6) AS mean_offset, round(sd, 6) AS sd, "offset", is_plus, is_bad FROM pairs',
)
add(
    "read_report", f"{READS},\nscored AS (SELECT x, count(*) FILTER (NOT is_bad) AS g, count(*) FILTER (is_bad) AS b FROM pairs GROUP BY x)",
    "SELECT t.*, coalesce(n_repeat, 0) AS n_repeat, coalesce(g, 0) AS n_good, coalesce(b, 0) AS n_bad FROM table_ t "
    "LEFT JOIN repeats USING (read_id) LEFT JOIN scored ON x = t.read_id",
)
add("bad_overlap_counts", READS, "SELECT x, count(*) FILTER (is_bad) AS n_bad FROM pairs GROUP BY x")
# Flags as bits: repeat 1, many bad 2, some bad 4, no match 8, few hits 16, few single-copy hits 32.
FACTS = (
    f"{READS},\nfacts AS MATERIALIZED (SELECT t.read_id AS id, CASE WHEN coalesce(n_repeat, 0) > 0 THEN 1 ELSE 0 END AS rep, t.n_hit, t.n_copy1 "
    "FROM table_ t LEFT JOIN repeats USING (read_id)),\nlinks AS MATERIALIZED (SELECT x, y, is_bad FROM pairs)"
)


def _new_mask(old: str, rep: str, n_hit: str, n_copy1: str, seen: str, bad: str, pass_: str) -> str:
    return (
        f"({old} | {rep} | CASE WHEN {pass_} = 1 AND {bad} >= 10 THEN 2 ELSE 0 END "
        f"| CASE WHEN {pass_} > 1 AND {bad} >= 4 - {pass_} AND ({old} & 2) = 0 THEN 4 ELSE 0 END "
        f"| CASE WHEN {seen} > 0 THEN 0 WHEN {n_hit} < 10 THEN 24 WHEN {n_copy1} < 10 THEN 40 ELSE 8 END)"
    )


def _unmask(mask: str) -> str:
    names = ("bad_repeat", "bad_order10", "bad_order1", "bad_no_match", "bad_low_hit", "bad_low_copy1")
    return ", ".join(f"({mask} & {1 << i}) > 0 AS {name}" for i, name in enumerate(names)) + f", {mask} > 0 AS bad"


_frozen = FACTS + ",\nm0 AS (SELECT id, 0 AS mask FROM facts)"
for _pass in (1, 2, 3):
    _frozen += (
        f",\ns{_pass} AS (SELECT x, count(*) AS seen, count(*) FILTER (is_bad) AS bad FROM links JOIN m{_pass - 1} m ON m.id = y "
        "JOIN facts f ON f.id = y WHERE m.mask = 0 AND NOT (x = y AND f.rep = 1) GROUP BY x),\n"
        f"m{_pass} AS (SELECT f.id, "
        + _new_mask("m.mask", "f.rep", "f.n_hit", "f.n_copy1", "coalesce(seen, 0)", "coalesce(s.bad, 0)", str(_pass))
        + f" AS mask FROM facts f JOIN m{_pass - 1} m ON m.id = f.id LEFT JOIN s{_pass} s ON s.x = f.id)"
    )
add("bad_reads_frozen", _frozen, f"SELECT id AS read_id, {_unmask('mask')} FROM m3")
# One step per read and pass: the masks of the pass before, and those given so far in this pass.
SEQUENTIAL = (
    f"{FACTS},\nlast_id AS (SELECT max(id) AS top FROM facts),\n"
    "scan AS (SELECT 1 AS pass, 0::BIGINT AS id, list_transform(range((SELECT top + 1 FROM last_id)), lambda q: 0) AS before, []::INT[] AS now "
    "UNION ALL SELECT CASE WHEN done THEN pass + 1 ELSE pass END, CASE WHEN done THEN 0 ELSE id + 1 END, "
    "CASE WHEN done THEN list_append(now, mask) ELSE before END, CASE WHEN done THEN []::INT[] ELSE list_append(now, mask) END FROM ("
    "SELECT pass, id, before, now, id = (SELECT top FROM last_id) AS done, "
    + _new_mask("before[id + 1]", "rep", "n_hit", "n_copy1", "seen", "bad", "pass")
    + " AS mask FROM (SELECT any_value(s.pass) AS pass, any_value(s.id) AS id, any_value(s.before) AS before, any_value(s.now) AS now, "
    "any_value(f.rep) AS rep, any_value(f.n_hit) AS n_hit, any_value(f.n_copy1) AS n_copy1, "
    "count(*) FILTER (l.y IS NOT NULL AND NOT hidden) AS seen, count(*) FILTER (l.is_bad AND NOT hidden) AS bad FROM ("
    "SELECT s.*, l.y, l.is_bad, CASE WHEN l.y < s.id THEN s.now[l.y + 1] > 0 WHEN l.y = s.id THEN (s.before[l.y + 1] > 0) "
    "ELSE s.before[l.y + 1] > 0 END AS hid FROM scan s LEFT JOIN links l ON l.x = s.id WHERE s.pass <= 3) s "
    "JOIN facts f ON f.id = s.id, LATERAL (SELECT s.hid OR (s.y = s.id AND f.rep = 1) AS hidden, s.y AS y, s.is_bad AS is_bad) l) "
    "WHERE pass IS NOT NULL)),\n"
    "masks AS (SELECT unnest(range(len(before))) AS id, unnest(before) AS mask FROM scan WHERE pass = 4)"
)
add("bad_reads", SEQUENTIAL, f"SELECT id AS read_id, {_unmask('mask')} FROM masks", recursive=True)
CONTAINED = (
    f"{SEQUENTIAL},\ngood AS (SELECT id, len FROM masks JOIN table_ ON read_id = id WHERE mask = 0),\n"
    "covers AS (SELECT x, y, n_hit, row_number() OVER (PARTITION BY x ORDER BY n_hit DESC, y) AS r FROM pairs "
    "JOIN good a ON a.id = x JOIN good b ON b.id = y WHERE x <> y AND b.len >= a.len AND CASE WHEN is_plus THEN "
    '"offset" <= 0 AND "offset" + b.len >= a.len ELSE "offset" >= a.len AND "offset" - b.len <= 0 END),\n'
    "contained AS (SELECT g.id AS read_id, g.len, c.y AS contained_in, c.n_hit FROM good g LEFT JOIN covers c ON c.x = g.id AND c.r = 1)"
)
add("contained_reads", CONTAINED, "SELECT * FROM contained", recursive=True)
add(
    "containment_summary", CONTAINED,
    "SELECT count(contained_in) AS n_contained, count(*) - count(contained_in) AS n_free, "
    "round(coalesce(avg(len) FILTER (contained_in IS NULL), 0.0), 6) AS free_avg_len FROM contained",
    recursive=True,
)
add(
    "overlap_hit_pairs",
    f"{CONTAINED},\nread_depths AS (SELECT hash, count(*) AS depth FROM rh GROUP BY hash)",
    "SELECT c.read_id AS x, c.contained_in AS y, a.hash, depth, CASE WHEN a.is_fwd = b.is_fwd THEN '+' ELSE '-' END AS strand, "
    "a.pos AS x_pos, CASE WHEN a.is_fwd THEN 'F' ELSE 'R' END AS x_strand, b.pos AS y_pos, "
    "CASE WHEN b.is_fwd THEN 'F' ELSE 'R' END AS y_strand FROM contained c JOIN single a ON a.read_id = c.read_id "
    "JOIN single b ON b.read_id = c.contained_in AND b.hash = a.hash JOIN read_depths d ON d.hash = a.hash",
    recursive=True,
)


def _frac(a: str, b: str, name: str) -> str:
    return f"round({a}::DOUBLE / nullif({b}, 0), 6) AS {name}"


add(
    "readset_stats", f"{SEQUENTIAL},\nt AS (SELECT * FROM table_ JOIN masks ON id = read_id)",
    "SELECT count(*) AS n_reads, sum(len) AS total_len, " + _frac("sum(len)", "count(*)", "avg_len")
    + ", sum(n_hit) AS total_hit, " + _frac("sum(len)", "sum(n_hit)", "bp_per_hit") + ", "
    + _frac("sum(n_hit)", "(sum(n_hit) + sum(n_miss))", "frac_hit") + ", " + _frac("sum(n_hit)", "count(*)", "hits_per_read") + ", "
    + ", ".join(_frac(f"sum(n_copy{c})", "sum(n_hit)", f"frac_copy{c}") for c in range(4))
    + ", count(*) FILTER (n_copy1 = 0) AS n_unique0, count(*) FILTER (n_copy1 = 1) AS n_unique1, count(*) FILTER (n_copy1 > 1) AS n_unique_multi, "
    "round(avg(len) FILTER (n_copy1 = 0), 6) AS avg_len_unique0, round(avg(len) FILTER (n_copy1 = 1), 6) AS avg_len_unique1, "
    "round(avg(len) FILTER (n_copy1 > 1), 6) AS avg_len_unique_multi, round(avg(n_copy1) FILTER (n_copy1 > 1), 6) AS avg_copy1_unique_multi, "
    "count(*) FILTER (mask > 0) AS n_bad, "
    + ", ".join(
        f"count(*) FILTER ((mask & {1 << i}) > 0) AS n_{name}" for i, name in enumerate(
            ("bad_repeat", "bad_order10", "bad_order1", "bad_no_match", "bad_low_hit", "bad_low_copy1"))
    )
    + " FROM t",
    recursive=True,
)
add(
    "copy_class_stats", f"{READS},\nread_depths AS (SELECT hash, count(*) AS depth FROM rh GROUP BY hash)",
    "SELECT copy, count(*) AS n_hash, round(count(*) FILTER (d.depth > 0)::DOUBLE / count(*), 6) AS frac_hit, "
    "round(count(*) FILTER (d.depth > 1)::DOUBLE / count(*), 6) AS frac_hit2, round(avg(d.depth) FILTER (d.depth > 1), 6) AS avg_depth2 "
    "FROM kept c LEFT JOIN read_depths d USING (hash) GROUP BY copy",
)
ASSEMBLY = (
    f"{READS},\npicked AS (SELECT * FROM pairs WHERE x = (SELECT x FROM pairs GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)),\n"
    "placed AS (SELECT rh.*, row_number() OVER (PARTITION BY rh.read_id ORDER BY ord) AS r, "
    'lead(rh.hash) OVER (PARTITION BY rh.read_id ORDER BY ord) AS next_hash, "offset" + CASE WHEN is_plus THEN pos ELSE -pos END AS place '
    "FROM rh JOIN picked ON y = read_id),\n"
    "pooled AS (SELECT hash, copy, count(*) AS count, count(*) FILTER (r > 1) AS up_count, "
    "trunc(sum(place)::DOUBLE / count(*))::BIGINT AS pos FROM placed GROUP BY hash, copy)"
)
add(
    "assembly_summary", ASSEMBLY,
    "SELECT count(*) AS n_hash, round(avg(count), 6) AS mean_count FROM pooled",
)
add(
    "read_hit_gaps", READS,
    "SELECT read_id, ord, pos, (pos - coalesce(lag(pos) OVER (PARTITION BY read_id ORDER BY ord), 0)) AS dx FROM rh",
)
add("read_hit_positions", READS, "SELECT read_id, ord, pos FROM rh")
add("assembly_hits", ASSEMBLY, "SELECT * FROM pooled")
add(
    "assembly_support", f"{ASSEMBLY},\nread_depths AS (SELECT hash, count(*) AS depth FROM rh GROUP BY hash)",
    "SELECT count, depth, (10 * count - 1) // depth AS decile, count(*) AS n "
    "FROM pooled JOIN read_depths USING (hash) WHERE copy = 1 GROUP BY 1, 2, 3",
)
add(
    "assembly_successors", ASSEMBLY,
    "SELECT hash, next_hash, count(*) AS n FROM placed WHERE next_hash IS NOT NULL GROUP BY hash, next_hash",
)
