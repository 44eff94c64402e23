"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from evalloom.llm import mixing

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def line_dedup() -> str:
    stripped = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
    return f"""
    WITH lines AS (
      SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    ), keyed AS (SELECT *, {ASCII_LOWER.format(stripped)} AS k FROM lines),
    first AS (
      SELECT k, min(doc_id) AS f FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
    ), marked AS (SELECT keyed.*, f IS NOT NULL AND f <> doc_id AS gone FROM keyed LEFT JOIN first USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


def mixed() -> str:
    b, seed = mixing.BLOCK_WORDS, mixing.SEED
    weights = ", ".join(str(w) for w in mixing.WEIGHTS)
    number = "CAST(concat('0x', substr(md5({}), 1, 15)) AS BIGINT)"
    rounds = []
    for r in range(1, mixing.ROUNDS + 1):
        other = f"((((k0 + {r} * k1) % n - x) % n + n) % n)"
        rounds.append(f"""
    o{r} AS (SELECT *, {other} AS y FROM x{r - 1}),
    x{r} AS (SELECT * EXCLUDE (x, y), CASE WHEN substr(md5(concat_ws(':', key, '{r}', greatest(x, y))), 1, 1) < '8' THEN y ELSE x END AS x FROM o{r})""")
    return rf"""
    WITH docs AS (
      SELECT row_number() OVER () AS rid, doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents
    ), by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
    ranked AS (
      SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS sid FROM by_source
    ), weighed AS (
      SELECT *, CAST(([{weights}])[(sid - 1) % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS w, CAST(source_size * {mixing.LIMIT} AS DOUBLE) AS cap FROM ranked
    ), levels AS (
      SELECT *, ({mixing.SHARE} * CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed
    ), targets AS (
      SELECT source, sid, source_size, least(cap, max(lv) OVER () * w) AS target FROM levels
    ), sources AS (
      SELECT *, least(CAST(round(target) AS BIGINT), source_size * {mixing.LIMIT}) AS words, source_size // {b} AS nf,
        source_size // {b} + CASE WHEN source_size % {b} > 0 THEN 1 ELSE 0 END AS nb FROM targets
    ), passes AS (
      SELECT *, CASE WHEN source_size > 0 THEN CAST((words // source_size) * nb + ceil((words - (words // source_size) * source_size) / {b}.0) AS BIGINT) ELSE 0 END AS ns FROM sources
    ), slots AS (
      SELECT sid, source_size, words, nf, unnest(range(ns)) AS t, nb FROM passes
    ), x0 AS (
      SELECT sid, source_size, words, nf, t // nb AS epoch, t % nb AS j, greatest(nf, 1) AS n, t % nb AS x,
        concat_ws(':', '{seed}', sid, t // nb) AS key,
        {number.format(f"concat_ws(':', '{seed}', sid, t // nb, 'first')")} % greatest(nf, 1) AS k0,
        {number.format(f"concat_ws(':', '{seed}', sid, t // nb, 'step')")} % greatest(nf, 1) AS k1 FROM slots
    ), {",".join(rounds)},
    placed AS (
      SELECT sid, CASE WHEN j < nf THEN x ELSE nf END AS block, least({b}, least(words - epoch * source_size, source_size) - j * {b}) AS len FROM x{mixing.ROUNDS}
    ), streams AS (
      SELECT rid, doc_id, docs.source, sid, size, source_size, target, coalesce(CAST(sum(size) OVER (
        PARTITION BY sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
      FROM docs JOIN passes ON docs.source IS NOT DISTINCT FROM passes.source
    ), spans AS (
      SELECT rid, sid, start, size, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM streams WHERE size > 0
    ), took AS (
      SELECT rid, sum(greatest(0, least(start + size, block * {b} + len) - greatest(start, block * {b}))) AS taken
      FROM spans JOIN placed USING (sid, block) GROUP BY rid
    )
    SELECT doc_id, source, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM streams LEFT JOIN took USING (rid)"""


def perspectives(turns_per_part: int) -> str:
    return f"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
    turns AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(speaker || chr(10) || text), speaker, text) - 1 AS place FROM said
    ), sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'),
    pieces AS (
      SELECT t.conv_id, perspective, place, speaker, text, speaker = perspective AS loss,
        CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
          ELSE concat('<|user:', speaker, '|>') END || chr(10) AS head
      FROM turns t JOIN sides s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
    ), cut AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece, CAST(place // {turns_per_part} AS BIGINT) AS part FROM pieces),
    placed AS (
      SELECT *, coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER w AS pos
      FROM cut WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY place)
    )
    SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(piece, '' ORDER BY pos) AS rendered,
      coalesce(string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(piece) - 1 AS BIGINT), ',' ORDER BY pos) FILTER (loss), '') AS spans
    FROM placed GROUP BY conv_id, perspective, part"""


def jaccard_components() -> str:
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(ASCII_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM docs
    ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
    reach(id, m) AS (SELECT doc_id, doc_id FROM docs UNION SELECT links.b, reach.m FROM reach JOIN links ON links.a = reach.id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, r.component_id
    FROM (SELECT DISTINCT doc_id FROM docs) d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id AS doc_id, min(m) AS component_id FROM reach GROUP BY id) r USING (doc_id)"""


def ranked() -> str:
    terms = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(ASCII_LOWER.format("coalesce(text, '')"))
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents),
    size AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM docs WHERE len(t) > 0),
    whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM size),
    held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
    found AS (SELECT term, count(*) AS df FROM held GROUP BY term),
    items AS (SELECT row_number() OVER () AS q, item_id, {terms} AS t FROM benchmark),
    asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM items) GROUP BY q, item_id, term),
    weighed AS (
      SELECT q, item_id, term, times, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM asked JOIN found USING (term), whole
    ), scored AS (
      SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
      FROM weighed JOIN held USING (term) JOIN size USING (r), whole GROUP BY q, item_id, r, doc_id
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, by its table; the statement must have a one-row relation ``crc`` with column ``ct``."""
    byte = f"CAST(concat('0x', substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)"
    step = f"xor(h >> 8, ct[CAST(xor(h & 255, b) AS BIGINT) + 1])"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: {byte})), lambda h, b: {step}))"
    )


CRC_TABLE = """crc AS (
      SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)),
        lambda h, i: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) AS ct)"""


def variants() -> str:
    # Code points U+00C0 to U+00FF as one byte each: the edit distance of the engine counts bytes.
    wide = "".join(chr(c) for c in range(0xC0, 0x100))
    narrow = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "!#$%&()*+,-./:;<=>?@[]^_{|}~"[:28]
    runs = f"regexp_extract_all({ASCII_LOWER.format('text')}, '[a-zÀ-ÿ]+')"
    return f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
      SELECT d, r, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest({runs}) AS r FROM documents)
      WHERE length(r) >= 6 GROUP BY d, r
    ), hashed AS (SELECT r, c, {crc32("concat(d, ':', r)")} AS h FROM runs, crc),
    typed AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(r, 1, h % length(r)), substr(r, h % length(r) + 2)) ELSE r END AS word, c FROM hashed),
    words AS MATERIALIZED (
      SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS size, translate(word, '{wide}', '{narrow}') AS bytes
      FROM typed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
    ), near AS (
      SELECT a.word, a.n, b.word AS other, b.n AS m FROM words a JOIN words b ON b.size IN (a.size - 1, a.size, a.size + 1) AND a.word <> b.word
      WHERE levenshtein(a.bytes, b.bytes) = 1
    ), best AS (
      SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
    ), formed AS MATERIALIZED (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
      FROM words w LEFT JOIN best USING (word)
    ), chains AS (
      SELECT word, word AS root, form AS ahead FROM formed
      UNION ALL SELECT c.word, c.ahead, f.form FROM chains c JOIN formed f ON f.word = c.ahead
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chains WHERE ahead IS NULL) USING (word)"""
