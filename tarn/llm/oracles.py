"""DuckDB SQL for the operators that SQL can express: 2, 3, 5, 6, 9, 10, 11, 12 and 13.

Token ids (1, 7), sketches with alignment (4) and markup (8) are beyond it; tests/llm holds those
against brute force.
"""

from tarn.llm import manifest, mixing, passages, preferences, quality, repair, shards, urls

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quality() -> str:
    each = " union all ".join(f"select lang, source, '{name}' measure, {count} * {scale} // {size} v from counts where not base_failed" for name, (count, size, scale, _) in quality.MEASURES.items())

    def beyond_fence(name: str) -> str:
        count, size, scale, unit = quality.MEASURES[name]
        excess = f"({count}::double * {scale} - fence['{name}']::double * {size}::double)"
        return f"case when {excess} > 0 and {excess} * {excess} > {(quality.Z * scale) ** 2 * unit}::double * {count}::double then '{name}' end"

    beyond = ", ".join(map(beyond_fence, quality.MEASURES))

    def fence(columns: str, rows: str) -> str:
        by = columns + ", " if columns else ""
        high, mid = (f"min(top) filter (up_to * 10 >= n_all * {q})" for q in (quality.TAIL, 5))
        return f"""
        select {by}measure, cast(high + {quality.REACH} * (high - mid) as bigint) fence from (
          select {by}measure, {high} high, {mid} mid
          from (select {by}measure, top, sum(weight) over (partition by {by}measure order by bucket) up_to, sum(weight) over (partition by {by}measure) n_all from {rows}) group by {by}measure)"""

    def lent(rows: str, by: str) -> str:
        return f"(select *, weight * {quality.PRIOR_ROWS * quality.PARTS} // sum(weight) over (partition by {by}measure) part from {rows})"

    return f"""
    with docs as (select doc_id, coalesce('=' || lang, '') lang, coalesce('=' || source, '') source, coalesce(text, '') text, {_WORDS} w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) l from documents),
    windows as (select doc_id, p, array_to_string(w[p:p + 4], ' ') win from (select doc_id, w, unnest(range(1, len(w) - 3)) p from docs where len(w) >= 5)),
    again as (select doc_id, unnest(range(p, p + 5)) p from (select *, count(*) over (partition by doc_id, win) c from windows) where c > 1),
    repeats as (select doc_id, count(distinct p) n from again group by 1),
    base as (select doc_id, lang, source, len(w) n_words, length(array_to_string(w, '')) word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
        len(l) - len(list_distinct(l)) n_dup_lines, len(l) n_lines, coalesce(r.n, 0) n_repeat_words from docs left join repeats r using (doc_id)),
    counts as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base),
    measured as ({each}),
    shifted as (select *, greatest(0, case when v < 1 then 0 else cast(floor(log2(v)) as int) + 1 end - 6) s from measured),
    sketch as (select lang, source, measure, s * 32 + (v >> s) bucket, any_value((((v >> s) + 1) << s) - 1) top, count(*) n from shifted group by all),
    overall as (select measure, bucket, any_value(top) top, sum(n) * {quality.PARTS} weight from sketch group by all),
    of_lang as (select lang, measure, bucket, any_value(top) top, sum(weight) weight from (
        select lang, measure, bucket, top, n * {quality.PARTS} weight from sketch union all
        select k.lang, measure, bucket, top, part from (select distinct lang, measure from sketch) k join {lent("overall", "")} using (measure)) group by all),
    of_source as (select lang, source, measure, bucket, any_value(top) top, sum(weight) weight from (
        select lang, source, measure, bucket, top, n * {quality.PARTS} weight from sketch union all
        select lang, k.source, measure, bucket, top, part from (select distinct lang, source, measure from sketch) k join {lent("of_lang", "lang, ")} using (lang, measure)) group by all),
    lang_fence as ({fence("lang", "of_lang")}), source_fence as ({fence("lang, source", "of_source")}),
    fences as (select lang, source, map_from_entries(list((measure, least(s.fence, {quality.LIMIT} * l.fence)))) fence from source_fence s join lang_fence l using (lang, measure) group by all),
    judged as (select c.*, case when base_failed then [] else list_sort(list_filter([{beyond}], lambda x: x is not null)) end beyond from counts c left join fences using (lang, source))
    select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words, base_failed,
        not base_failed and len(beyond) = 0 kept, array_to_string(beyond, ',') beyond from judged"""


#: The table of CRC-32, made by its rule, and the checksum of a string, one byte at a time.
_CRC_STEP = "list_reduce(list_prepend(k, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
_CRC_TABLE = f"crc as (select list(v order by k) t from (select k, {_CRC_STEP} v from range(256) r(k)))"


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::bigint)),
            lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))::bigint"""


def _shards() -> str:
    return f"""
    with {_CRC_TABLE},
    docs as (select doc_id, source, text, octet_length(encode(coalesce(text, ''))) + 1 size, md5('{shards.SEED}:' || coalesce(doc_id::varchar, '')) key from documents),
    fractions as (select *, (2 * row_number() over (partition by source order by key) - 1) / (2 * count(*) over (partition by source))::double fraction from docs),
    places as (select *, row_number() over (order by fraction, source nulls first, key) - 1 place, count(*) over () total from fractions),
    dealt as (select *, place * 8 // total shard from places)
    select doc_id, size::bigint size, {_crc32("coalesce(text, '')")} text_crc32,
        'rows' law, shard::int shard, (place - (shard * total + 7) // 8)::bigint slot, null::int grown_shard, source from dealt, crc"""


def _decontamination() -> str:
    return f"""
    with docs as (select doc_id, {_ALNUM} w from documents), items as (select item_id::varchar item, {_ALNUM} w from benchmark),
    wanted as (select distinct item, case when len(w) < 13 then w else w[p:p + 12] end win from (select item, w, unnest(range(1, greatest(2, len(w) - 11))) p from items where len(w) > 0)),
    sizes as (select distinct len(win) n from wanted),
    windows as (select doc_id, n, p, w[p:p + n - 1] win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from docs, sizes where len(w) >= n)),
    hits as (select doc_id, n, p, item from windows join wanted using (win)),
    hit_words as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + n)) q from hits) group by 1),
    hit_items as (select doc_id, list_sort(list(distinct item)) items from hits group by 1)
    select doc_id, len(w)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(len(items), 0)::bigint n_items, sha256(coalesce(array_to_string(items, ','), '')) items_sha256,
        coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(w) contaminated from docs left join hit_words h using (doc_id) left join hit_items using (doc_id)"""


def _passages() -> str:
    n = passages.WINDOW
    return f"""
    with docs as (select doc_id, {_WORDS} w from documents),
    windows as (select doc_id, p, array_to_string(w[p:p + {n - 1}], ' ') win from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) p from docs where len(w) >= {n})),
    later as (select doc_id, p from (select *, min(doc_id) over (partition by win) f from windows) where doc_id > f),
    gone as (select doc_id, list(distinct q) g, count(distinct q) n from (select doc_id, unnest(range(p, p + {n})) q from later) group by 1)
    select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed,
        sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(g, i)) end, ' ')) kept_sha256 from docs left join gone using (doc_id)"""


def _preferences() -> str:
    head, end = len(preferences.BEFORE) + len(preferences.AFTER_ROLE), len(preferences.END)

    def rendered(turns: str) -> str:
        return f"array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"

    def trained(turns: str) -> str:
        before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda q: length(q.role) + length(q.text) + {head + end})), 0)::bigint"
        one = f"({before} + {head} + length(t.role))::varchar || '-' || ({before} + {head + end} + length(t.role) + length(t.text))::varchar"
        return f"array_to_string(list_filter(list_transform({turns}, lambda t, i: case when t.role = '{preferences.TRAINED_ROLE}' then {one} end), lambda x: x is not null), ',')"

    return f"""
    with turns as (select conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')) order by turn, coalesce(role, ''), coalesce(text, '')) t
        from conversations where conv_id is not null group by 1),
    known as (select conv_id, t, coalesce(list_max(list_filter(list_transform(t, lambda x, i: case when x.role = '{preferences.TRAINED_ROLE}' then i else 0 end), lambda i: i > 0)), 0) a from turns),
    replies as (select conv_id, coalesce(lead(t[a].text) over (order by conv_id), first_value(t[a].text) over (order by conv_id)) reply from known where a > 0),
    sides as (select conv_id, case when a > 0 then t[1:a] else t end c,
        case when a = 0 then t else list_append(t[1:a - 1], struct_pack(turn := t[a].turn, role := t[a].role, text := reply)) end r
        from known left join replies using (conv_id)),
    prefixes as (select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role <> r[i].role or c[i].text <> r[i].text)) - 1, least(len(c), len(r))) p from sides),
    cut as (select conv_id, p, c[1:p] head, c[p + 1:len(c)] c, r[p + 1:len(r)] r from prefixes)
    select conv_id, p::int prompt_turns, {rendered("head")} prompt, {rendered("c")} chosen, {rendered("r")} rejected, {trained("c")} chosen_trained, {trained("r")} rejected_trained from cut"""


def _urls() -> str:
    by_length = sorted(urls.RULES, key=lambda r: -len(r[0]))
    fits = [(rule, says, f"(host = '{rule.partition('/')[0]}' or ends_with(host, '.{rule.partition('/')[0]}')) and starts_with(path, '/{rule.partition('/')[2]}')") for rule, says in by_length]
    rule = "case " + " ".join(f"when {fit} then '{r}'" for r, _, fit in fits) + " end"
    ruled = "case " + " ".join(f"when {fit} then '{says}'" for _, says, fit in fits) + " end"

    def hits(terms) -> str:
        return f"len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))::int"

    return f"""
    with folded as (select page_id, coalesce(url, '') url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from pages),
    parts as (select page_id, low, regexp_extract(low, '(?s)^.*?://([^/?#]*)', 1) host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from folded),
    counted as (select *, {hits(urls.STRICT)} strict_hits, {hits(urls.SOFT)} soft_hits from parts)
    select page_id, host, path, {rule} as rule, coalesce({ruled}, case when strict_hits > 0 or soft_hits >= {urls.SOFT_LIMIT} then 'block' else 'allow' end) verdict, strict_hits, soft_hits from counted"""


def _mix() -> str:
    """All sources that are over their limit are a prefix of those in order of limit by weight."""
    weight = "case (row_number() over (order by source is null, source) - 1) % 3 " + " ".join(f"when {i} then {w}" for i, w in enumerate(mixing.WEIGHTS)) + " end"
    passes = range(mixing.LIMIT)
    budget = "least(source_size::double, greatest(0, target - {} * source_size))"
    taken = " + ".join(f"(up_to <= {b} or up_to - size < {b} and up_to - {b} <= {b} - (up_to - size))::int" for b in (budget.format(j) for j in passes))
    return f"""
    with docs as (select doc_id, source, len({_WORDS})::bigint size, substring(md5('{mixing.SEED}:' || doc_id), 1, {mixing.IDENTITY_DIGITS}) place from documents),
    sources as (select source, sum(size)::hugeint source_size, {weight}::hugeint weight from docs group by source),
    ordered as (select *, {mixing.LIMIT} * source_size most, row_number() over (order by {mixing.LIMIT} * source_size / weight, source nulls last) n from sources),
    levels as (select *, sum(source_size) over () - coalesce(sum(most) over (order by n rows between unbounded preceding and 1 preceding), 0) rest, sum(weight) over (order by n rows between current row and unbounded following) open_weight from ordered),
    first_open as (select n, rest, open_weight from levels where most * open_weight >= weight * rest order by n limit 1),
    goals as (select source, source_size, case when o.n < f.n then o.most::double else o.weight::double * f.rest::double / f.open_weight::double end target from ordered o, first_open f),
    summed as (select doc_id, size, source_size, target, sum(size) over (partition by d.source order by place) up_to from docs d join goals g on d.source is not distinct from g.source)
    select doc_id, size, source_size::bigint source_size, target, (size * ({taken}))::bigint taken from summed"""


def _repair() -> str:
    """The recursion as a fold from the last turn on: cost and audit for each end of what is repaired so far."""
    ends, inf = ("", "s", "u", "a"), 1_000_000_000
    name = {e: e or "n" for e in ends}

    def pick(options: list[tuple[str, str]]) -> tuple[str, str]:
        """(cost, audit) of the least option."""
        least = f"list_min([{', '.join(f'struct_pack(c := {c}, a := {a})' for c, a in options)}])"
        return f"{least}.c", f"{least}.a"

    def closed(base: dict[str, tuple[str, str]]) -> str:
        """Insertions before the next edit: at most two, to the end that follows."""
        once = {e: (f"{base[repair.NEXT[e][-1]][0]} + {repair.INSERT}", f"'I' || {base[repair.NEXT[e][-1]][1]}") for e in ends}
        twice = {e: (f"{base[repair.NEXT[repair.NEXT[e][-1]][-1]][0]} + {2 * repair.INSERT}", f"'II' || {base[repair.NEXT[repair.NEXT[e][-1]][-1]][1]}") for e in ends}
        fields = []
        for e in ends:
            cost, audit = pick([base[e], once[e], twice[e]])
            fields += [f"c_{name[e]} := {cost}::bigint", f"e_{name[e]} := {audit}"]
        return ", ".join(fields)

    stays = f"case when x.sym = upper(x.sym) then {repair.TRUNCATED} else 0 end"
    base = {}
    for e in ends:
        options = [(f"s.c_{name[e]} + {repair.DELETE}", f"'D' || s.e_{name[e]}")]
        for role in repair.NEXT[e]:
            options.append((f"case when lower(x.sym) = '{role}' then s.c_{role} + {stays} else {inf} end", f"'K' || s.e_{role}"))
            if role in repair.GIVEN:
                options.append((f"case when x.sym <> '{repair.GOES}' then s.c_{role} + {stays} + {repair.REROLE} else {inf} end", f"'R' || s.e_{role}"))
        base[e] = pick(options)
    at_end = {e: ("0" if e in ("", "a") else str(inf), "''") for e in ends}
    fields = [f"{k}_{name[e]}" for e in ends for k in ("c", "e")]
    blank = f"struct_pack(sym := x, {', '.join(f'{f} := ' + ('0::bigint' if f[0] == 'c' else repr('')) for f in fields)})"
    # each step names the bases first, so that a text stands once
    inner = ", ".join(f"c_{name[e]} := {base[e][0]}::bigint, e_{name[e]} := {base[e][1]}" for e in ends)
    step = f"list_transform([struct_pack({inner})], lambda b: struct_pack(sym := '', {closed({e: (f'b.c_{name[e]}', f'b.e_{name[e]}') for e in ends})}))[1]"
    solve = f"list_reduce(list_prepend(struct_pack(sym := '', {closed(at_end)}), list_reverse(list_transform(syms, lambda x: {blank}))), lambda s, x: {step})"
    role = f"case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '{repair.OTHER}' end"
    white = r"\x20\x09-\x0D"
    return f"""
    with {_CRC_TABLE},
    original as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 k from conversations, crc),
    hurt as (select conv_id, turn, case when k = 4 then 'user' else role end role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(case k when 0 then 0 when 3 then 2 else 1 end)) copy from original),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i from hurt),
    seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 again, lag(left(role, 1)) over (partition by conv_id order by i) before from placed),
    judged as (select *, case when not regexp_matches(text, '[^{white}]') then 'blank' when again then 'duplicate' when regexp_matches(text, '[^.!?{white}][{white}]*$') then 'truncated' else '' end fault from seen),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
        count(*) filter (i > 1 and before || left(role, 1) not in ('su', 'ua', 'au')) illegal, list(struct_pack(role := role, text := text) order by i) t,
        list(case fault when 'blank' then '{repair.GOES}' when 'duplicate' then '{repair.GOES}' when 'truncated' then upper({role}) else {role} end order by i) syms from judged group by conv_id),
    solutions as (select *, {solve} best from counts),
    edits as (select *, list_transform(range(1, length(best.e_n) + 1), lambda j: struct_pack(op := best.e_n[j], r := length(replace(best.e_n[1:j], 'I', '')), o := length(replace(best.e_n[1:j], 'D', '')))) e from solutions),
    lines as (select *, list_filter(e, lambda x: x.op <> 'D') kept_edits, len(list_filter(e, lambda x: x.o = 1 and x.op = 'K' and lower(syms[x.r]) = 's')) shift from edits),
    texts as (select *, array_to_string(list_transform(kept_edits, lambda x: case when x.op = 'K' then t[x.r].role when (x.o - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || case when x.op = 'I' then '' else t[x.r].text end), chr(10)) body from lines)
    select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
        coalesce(best.c_n, 0)::bigint cost, coalesce(best.e_n, '') audit, sha256(coalesce(body, '')) repaired_sha256 from (select distinct conv_id from conversations) o left join texts d on o.conv_id is not distinct from d.conv_id"""


def _manifest() -> str:
    def leaf(text: str) -> str:
        return f"sha256(concat({', '.join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"

    def tree(name: str, leaves: str) -> str:
        n = manifest.ARITY
        return f"""{name} as (select of, 0 level, i, h, count(*) over (partition by of) n from {leaves}
            union all select of, level + 1, i // {n}, sha256(string_agg(h, '' order by i)), (n + {n - 1}) // {n} from {name} where n > 1 group by of, level, i // {n}, n)"""

    def steps(name: str, leaves: str) -> str:
        """For each leaf the nodes of its runs, its own as a star."""
        n = manifest.ARITY
        depths = f"select of, max(level) top from {name} group by of"
        return f"""select a.of, a.i, list(step order by level) steps from (select a.of, a.i, b.level, string_agg(case when b.i = a.i // pow({n}, b.level)::bigint then '*' else b.h end, '' order by b.i) step
            from {leaves} a join ({depths}) d on a.of = d.of join {name} b on b.of = a.of and b.level < d.top and b.i // {n} = a.i // pow({n}, b.level + 1)::bigint group by all) a group by a.of, a.i"""

    return f"""
    with recursive {_CRC_TABLE},
    leaves as (select *, coalesce('=' || source, '') of, row_number() over (partition by source order by doc_id nulls first, h) - 1 i from (
        select doc_id, source, {leaf("text")} h, {leaf("case when {crc} % 2 = 0 then replace(text, chr(10), '') else text end".format(crc=_crc32("doc_id::varchar")))} now from documents, crc)),
    {tree("nodes", "leaves")},
    tops as (select '' of, row_number() over (order by of) - 1 i, of source_of, h from (select of, h from nodes where n = 1)),
    {tree("upper", "tops")},
    lower_steps as ({steps("nodes", "leaves")}), upper_steps as ({steps("upper", "tops")}),
    paths as (select l.doc_id, l.h leaf, l.now, t.h subroot, (select h from upper where n = 1) root, coalesce(a.steps, []) || coalesce(b.steps, []) steps
        from leaves l join tops t on t.source_of = l.of left join lower_steps a on a.of = l.of and a.i = l.i left join upper_steps b on b.i = t.i),
    done as (select *, list_reduce(list_prepend(now, steps), lambda d, p: sha256(replace(p, '*', d))) folded_root from paths)
    select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '*', '')) proof_sha256, folded_root, folded_root = root verified from done"""


ORACLES: dict[str, str] = {
    "op2_quality_rules": _quality(), "op3_stratified_shards": _shards(), "op5_decontamination": _decontamination(),
    "op6_repeated_passages": _passages(), "op9_preferences": _preferences(), "op10_url_filter": _urls(), "op11_hash_threshold_mix": _mix(), "op12_conversation_repair": _repair(), "op13_merkle_manifest": _manifest(),
}
