"""SQL for the queries that have one."""

LINES = r"""
with raw as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null
),
forms as (
  select doc_id, text, pos, regexp_replace(trim(line, e' \t\r\f'), '[^ \t\r\f]*[0-9][^ \t\r\f]*', '<*>', 'g') as form
  from raw where trim(line, e' \t\r\f') <> ''
),
rows as (
  select *, string_split_regex(form, '[ \t\r\f]+') as w, len(string_split_regex(form, '[ \t\r\f]+')) as n from forms
),
leaved as (select *, {'n': n, 'start': w[1:3]} as leaf from rows),
leaves as (select leaf from leaved group by leaf having count(distinct text) >= 5),
known as (select * from leaved where leaf in (select leaf from leaves)),
counted as (select leaf, form, any_value(w) as w, count(distinct text) as texts from known group by leaf, form),
places as (select leaf, form, texts, unnest(w) as token, generate_subscripts(w, 1) as place from counted),
constants as (select leaf, place, token from places group by leaf, place, token having sum(texts) >= 5),
templates as (
  select p.leaf, p.form, list({'place': p.place, 'token': p.token} order by p.place) as template, count(*) as fixed, any_value(len(c.w)) as n
  from places p join constants using (leaf, place, token) join counted c on c.leaf = p.leaf and c.form = p.form
  group by p.leaf, p.form
),
good as (select leaf, form, template from templates where fixed >= 0.7 * n),
held as (select k.doc_id, k.text, k.pos, g.leaf, g.template from known k join good g on k.leaf = g.leaf and k.form = g.form),
bad as (
  select leaf, template, min({'doc_id': doc_id, 'pos': pos}) as first from held group by leaf, template having count(distinct text) >= 5
),
drops as (
  select h.doc_id, list_sort(list(distinct h.pos)) as dropped
  from held h join bad b on h.leaf = b.leaf and h.template = b.template
  where {'doc_id': h.doc_id, 'pos': h.pos} <> b.first group by h.doc_id
)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::int as n_lines,
  list_transform(coalesce(x.dropped, []), lambda k: k::int) as dropped,
  case when x.dropped is null then d.text else array_to_string(
    list_filter(string_split(d.text, chr(10)), lambda line, k: not list_contains(x.dropped, k - 1)), chr(10)) end as text
from documents d left join drops x using (doc_id)
"""

ARCHIVES = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h, payload from p),
f as (select payload, min(page_id) as first from d group by payload)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (k // 4)::int, 5))::int >> (15 - 5 * (k % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d join f using (payload)
"""

VECTORS = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
),
reach as (select vec_id as a, vec_id as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from component
"""

SHINGLES = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g
  from w
),
n as (select w.doc_id, count(g) as n from w left join s using (doc_id) group by w.doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 75 * (x.n + y.n - i)),
reach as (select doc_id as a, doc_id as b from n union select r.a, l.b from reach r join links l on r.b = l.a),
component as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from component join n using (doc_id)
"""

#: The checksum is computed byte by byte; near words meet through wildcards and through all words with a letter removed.
VARIANTS = r"""
with recursive steps as (
  select list(v order by i) as crc_table from (
    select i, list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) as v
    from (select unnest(range(256))::bigint as i)
  )
),
runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents
),
lowered as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by all
),
bytes as (select id, run, n, hex(encode(id || ':' || run)) as h from lowered),
marked as (
  select run, n, xor(4294967295, list_reduce(
    list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint),
    lambda c, b: xor(c >> 8, crc_table[xor(c, b) % 256 + 1]), 4294967295::bigint)) as mark
  from bytes cross join steps
),
results as (
  select case when mark % 97 = 0 then run[1 : mark % length(run)] || run[mark % length(run) + 2 : length(run)] else run end as word, n from marked
),
words as (select word, sum(n)::bigint as n from results where length(word) >= 5 group by word having sum(n) >= 3),
places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
cut as (select word, n, i, word[1 : i - 1] as a, word[i + 1 : length(word)] as b from places),
near as (
  select x.word, y.word as other, y.n from cut x join cut y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from cut x join words y on y.word = x.a || x.b
  union select y.word, x.word, x.n from cut x join words y on y.word = x.a || x.b
),
best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n from near group by word),
formed as (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near,
    case when b.other_n >= 2 * w.n then b.other end as form, case when b.other_n >= 2 * w.n then b.other_n end as form_n
  from words w left join best b using (word)
),
ways as (
  select word, word as reached, 0 as depth from formed
  union all select w.word, f.form, depth + 1 from ways w join formed f on f.word = w.reached where f.form is not null
),
ends as (select word, arg_max(reached, depth) as root from ways group by word)
select word, form, root, n, n_near, form_n from formed join ends using (word)
"""


def _clusters(dims: int = 64, clusters: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and update, written one after the other; all sums stay whole numbers."""
    parts = [f"""
kept as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q,
    row_number() over (order by sha256('2:' || coalesce(vec_id::varchar, '')), embedding) - 1 as place
  from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims}
),
c0 as (select place as cluster, q as c from kept where place < {clusters})"""]
    for r in range(rounds + 1):
        parts.append(f"""
d{r} as (
  select v.place, v.vec_id, v.q, arg_min(cluster, (list_sum(list_transform(list_zip(v.q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), cluster)) as cluster,
    min(list_sum(list_transform(list_zip(v.q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as distance
  from kept v cross join c{r} group by v.place, v.vec_id, v.q
)""")
        if r < rounds:
            parts.append(f"""
e{r} as (select cluster, unnest(q) as x, unnest(range({dims})) as i from d{r}),
s{r} as (select cluster, i, sum(x)::bigint as s, count(*) as n from e{r} group by cluster, i),
m{r} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as c from s{r} group by cluster),
c{r + 1} as (select o.cluster, coalesce(m.c, o.c) as c from c{r} o left join m{r} m using (cluster))""")
    return "with" + ",".join(parts) + f"""
select vec_id, cluster::integer as cluster, distance::bigint as distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
  sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from d{rounds} join c{rounds} using (cluster)
"""


CLUSTERS = _clusters()
