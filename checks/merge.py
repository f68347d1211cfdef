"""Merge and enrolment queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnwise.operators import enrolments as e
from cairnwise.operators import merge as m
from cairnwise.sources.sample_tables import FIXED_AS_OF, SampleTables
from checks.tables import with_tables


def _q(fn):
    return lambda spark, sf: fn(SampleTables(spark, sf))


# -- batches -------------------------------------------------------------------


def item_batch(t):
    """Two rows per third item (the second one without a title), plus new items."""
    return t.items().where("item_id % 3 = 0").selectExpr(
        "explode(array("
        "named_struct('code', code, 'title', concat(title, ' v2'), 'favorites', favorites + 1, 'owner', CAST(NULL AS STRING), 'ord', item_id * 2),"
        "named_struct('code', code, 'title', CAST(NULL AS STRING), 'favorites', favorites + 2, 'owner', CAST(NULL AS STRING), 'ord', item_id * 2 + 1),"
        "named_struct('code', concat(code, 'N'), 'title', 'new', 'favorites', 0, 'owner', 'me', 'ord', item_id * 2))) AS b"
    ).select("b.*")


ITEM_BATCH = """SELECT code, concat(title, ' v2') AS title, favorites + 1 AS favorites, NULL AS owner, item_id * 2 AS ord FROM items WHERE item_id % 3 = 0
 UNION ALL SELECT code, NULL, favorites + 2, NULL, item_id * 2 + 1 FROM items WHERE item_id % 3 = 0
 UNION ALL SELECT concat(code, 'N'), 'new', 0, 'me', item_id * 2 FROM items WHERE item_id % 3 = 0"""


def _merged_items(t):
    existing = t.items().select("code", "title", "favorites", "owner", "difficulty")
    return m.upsert(existing, item_batch(t), ["code"], "ord")


def upsert_items(t):
    return _merged_items(t)


def upsert_items_counts(t):
    return m.change_counts(_merged_items(t))


MERGED_ITEMS = """SELECT coalesce(i.code, b.code) AS code, coalesce(b.title, i.title) AS title, coalesce(b.favorites, i.favorites) AS favorites, coalesce(b.owner, i.owner) AS owner, i.difficulty,
 CASE WHEN i.code IS NULL THEN 'inserted' WHEN b.code IS NULL THEN 'kept' ELSE 'updated' END AS change FROM items i FULL JOIN (
 SELECT code, max_by(title, ord) FILTER (WHERE title IS NOT NULL) AS title, max_by(favorites, ord) AS favorites, max_by(owner, ord) FILTER (WHERE owner IS NOT NULL) AS owner FROM batch GROUP BY code) b ON b.code = i.code"""


def _stored_finds(t):
    return t.finds().withColumn("notes", F.expr("CASE WHEN item_id % 2 = 0 THEN concat('n', item_id) END"))


STORED = "SELECT *, CASE WHEN item_id % 2 = 0 THEN concat('n', item_id) END AS notes FROM finds"


def find_batch(t):
    """Every third find again with a later date and notes; the same finds shifted
    to the next item; and some unknown codes."""
    base = t.finds().where("item_id % 3 = 0").selectExpr(
        "user_id", "item_id", "found_date", "(item_id + user_id) % 4 AS k"
    )
    code = "concat('GC', lpad(CAST({} AS STRING), 6, '0'))"
    return base.selectExpr(
        "user_id",
        "explode(array("
        f"named_struct('code', {code.format('item_id')}, 'found_date', date_add(found_date, 9), 'notes', CASE WHEN k = 1 THEN 'again' END, 'notes_present', k < 2, 'ord', item_id),"
        f"named_struct('code', {code.format('item_id + 1')}, 'found_date', found_date, 'notes', 'next', 'notes_present', true, 'ord', item_id),"
        f"named_struct('code', concat({code.format('item_id')}, 'X'), 'found_date', found_date, 'notes', 'lost', 'notes_present', true, 'ord', item_id))) AS b",
    ).select("user_id", "b.*")


FIND_BATCH = """SELECT user_id, item_id, CAST(found_date + 9 AS DATE) AS found_date, CASE WHEN (item_id + user_id) % 4 = 1 THEN 'again' END AS notes, (item_id + user_id) % 4 < 2 AS notes_present FROM finds WHERE item_id % 3 = 0
 UNION ALL SELECT user_id, item_id + 1, found_date, 'next', true FROM finds WHERE item_id % 3 = 0 AND item_id + 1 IN (SELECT item_id FROM items)"""


def upsert_finds(t):
    return m.upsert_finds(_stored_finds(t), find_batch(t), t.items())


def existing_items_by_code(t):
    return m.existing_items(find_batch(t), t.items())


def count_existing_finds(t):
    return m.count_existing_finds(find_batch(t), t.finds(), t.items())


def texts(t, finds=None):
    """Texts of a user (one per five thousand item numbers) listing codes of ``finds``
    (by default two thirds of them, so that a synchronisation has finds to delete), some lower-cased, plus codes of items not found and codes
    no item has."""
    words = (t.finds().where("item_id % 3 > 0") if finds is None else finds).selectExpr(
        "user_id", "item_id DIV 5000 AS part",
        "CASE item_id % 4 WHEN 0 THEN lower(concat('GC', lpad(CAST(item_id AS STRING), 6, '0')))"
        " WHEN 1 THEN concat('GC', lpad(CAST(item_id AS STRING), 6, '0'), ', gc', lpad(CAST(item_id + 1 AS STRING), 6, '0'), '.')"
        " WHEN 2 THEN concat('xGC', item_id, ' (GCQ', item_id, ')')"
        " ELSE concat('GC', lpad(CAST(item_id AS STRING), 6, '0'), ' GC', lpad(CAST(item_id AS STRING), 6, '0')) END AS w",
    )
    return words.groupBy("user_id", "part").agg(F.concat_ws(" ", F.sort_array(F.collect_list("w"))).alias("text"))


CODES = """SELECT DISTINCT user_id, upper(c) AS code FROM (SELECT user_id, unnest(CASE item_id % 4
 WHEN 0 THEN [concat('GC', lpad(CAST(item_id AS VARCHAR), 6, '0'))]
 WHEN 1 THEN [concat('GC', lpad(CAST(item_id AS VARCHAR), 6, '0')), concat('GC', lpad(CAST(item_id + 1 AS VARCHAR), 6, '0'))]
 WHEN 2 THEN [concat('GCQ', CAST(item_id AS VARCHAR))]
 ELSE [concat('GC', lpad(CAST(item_id AS VARCHAR), 6, '0'))] END) AS c FROM finds WHERE item_id % 3 > 0)"""


def extract_codes(t):
    return m.extract_codes(texts(t, t.finds())).select("user_id", "code").distinct()


def _actions(t):
    return m.sync_finds(m.extract_codes(texts(t)), t.finds(), t.items())


def sync_finds_full(t):
    return m.sync_report(_actions(t))


def sync_unknown(t):
    return _actions(t).where("action = 'unknown'").select("user_id", "code")


def sync_applied(t):
    return m.apply_sync(_stored_finds(t), _actions(t), FIXED_AS_OF)


SYNC = {
    "codes": CODES,
    "res": "SELECT c.user_id, c.code, i.item_id FROM codes c LEFT JOIN items i USING (code)",
    "cur": "SELECT user_id, item_id FROM finds WHERE user_id IN (SELECT user_id FROM codes)",
    "act": """SELECT coalesce(r.user_id, f.user_id) AS user_id, coalesce(r.item_id, f.item_id) AS item_id,
 CASE WHEN f.user_id IS NULL THEN 'add' WHEN r.user_id IS NULL THEN 'delete' ELSE 'keep' END AS action
 FROM (SELECT * FROM res WHERE item_id IS NOT NULL) r FULL JOIN cur f ON f.user_id = r.user_id AND f.item_id = r.item_id
 UNION ALL SELECT user_id, NULL, 'unknown' FROM res WHERE item_id IS NULL""",
}


def _some_challenges(t):
    return t.challenges().where("item_id % 80 = 3")


def create_challenges(t):
    return m.create_challenges(t.items(), _some_challenges(t))


def create_challenges_subset(t):
    return m.create_challenges(t.items(), _some_challenges(t), t.finds())


def create_challenges_counts(t):
    return m.challenge_counts(t.items(), _some_challenges(t))


# -- enrolments ------------------------------------------------------------------


def _full(t):
    return t.enrolments().selectExpr(
        "uc_id", "user_id", "challenge_id", "seed",
        "CASE WHEN seed % 13 = 0 THEN NULL WHEN seed % 13 = 1 THEN 'completed' ELSE status END AS status",
        "computed_status", "notes", "seed % 9 = 0 AS manual_override",
        "CASE WHEN seed % 9 = 0 THEN 'old reason' END AS override_reason", "CAST(seed % 100 AS DOUBLE) AS percent", "updated_at",
    )


FULL = """SELECT uc_id, user_id, challenge_id, seed, CASE WHEN seed % 13 = 0 THEN NULL WHEN seed % 13 = 1 THEN 'completed' ELSE status END AS status,
 computed_status, notes, seed % 9 = 0 AS manual_override, CASE WHEN seed % 9 = 0 THEN 'old reason' END AS override_reason, CAST(seed % 100 AS DOUBLE) AS percent, updated_at FROM enrolments"""


def patches(t):
    """One or two patches per third enrolment, valid and invalid, and unknown ids."""
    return _full(t).where("seed % 3 = 0").selectExpr(
        "explode(array("
        "named_struct('uc_id', uc_id, 'user_id', user_id, 'ord', 1, 'status', CASE seed % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'bogus' WHEN 3 THEN 'accepted' END,"
        " 'notes', CASE WHEN seed % 7 = 0 THEN repeat('x', 2001) WHEN seed % 7 = 1 THEN '   ' WHEN seed % 7 = 2 THEN ' hello ' END,"
        " 'reason', CASE WHEN seed % 11 = 0 THEN repeat('y', 501) WHEN seed % 11 = 1 THEN 'because' END),"
        "named_struct('uc_id', uc_id, 'user_id', CASE WHEN seed % 2 = 0 THEN user_id + 1 ELSE user_id END, 'ord', 2, 'status', CASE WHEN seed % 4 = 1 THEN 'dismissed' END,"
        " 'notes', 'second', 'reason', CAST(NULL AS STRING)))) AS p"
    ).select("p.*")


PATCHES = """SELECT uc_id, user_id, 1 AS ord, CASE seed % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'bogus' WHEN 3 THEN 'accepted' END AS status,
 CASE WHEN seed % 7 = 0 THEN repeat('x', 2001) WHEN seed % 7 = 1 THEN '   ' WHEN seed % 7 = 2 THEN ' hello ' END AS notes,
 CASE WHEN seed % 11 = 0 THEN repeat('y', 501) WHEN seed % 11 = 1 THEN 'because' END AS reason FROM full_uc WHERE seed % 3 = 0
 UNION ALL SELECT uc_id, CASE WHEN seed % 2 = 0 THEN user_id + 1 ELSE user_id END, 2, CASE WHEN seed % 4 = 1 THEN 'dismissed' END, 'second', NULL FROM full_uc WHERE seed % 3 = 0"""
CHECKED = """SELECT p.*, f.computed_status AS computed, CASE WHEN f.uc_id IS NULL THEN 'enrolment_unknown'
 WHEN p.status NOT IN ('pending','accepted','dismissed','completed') THEN concat('status_unknown: ', p.status)
 WHEN f.computed_status = 'completed' AND p.status IN ('pending','dismissed') THEN 'completed_by_find'
 WHEN length(p.notes) > 2000 THEN 'notes_long' WHEN length(p.reason) > 500 THEN 'reason_long' END AS error
 FROM patches p LEFT JOIN full_uc f ON f.uc_id = p.uc_id AND f.user_id = p.user_id"""
APPLIED = f"""SELECT f.uc_id, f.user_id, f.challenge_id, f.seed, coalesce(p.status, f.status) AS status,
 CASE WHEN auto THEN 'completed' ELSE f.computed_status END AS computed_status,
 CASE WHEN p.notes IS NOT NULL THEN nullif(trim(p.notes), '') ELSE f.notes END AS notes,
 CASE WHEN kind IS NOT NULL THEN true ELSE f.manual_override END AS manual_override,
 CASE WHEN kind = 'manual_completion' THEN 'Manual completion' WHEN p.reason IS NOT NULL THEN nullif(trim(p.reason), '') ELSE f.override_reason END AS override_reason,
 CASE WHEN kind = 'manual_completion' OR auto THEN 100.0 ELSE f.percent END AS percent,
 CASE WHEN p.uc_id IS NOT NULL THEN DATE '{FIXED_AS_OF}' ELSE f.updated_at END AS updated_at
 FROM full_uc f LEFT JOIN (SELECT uc_id, max_by(status, ord) FILTER (WHERE status IS NOT NULL) AS status, max_by(notes, ord) FILTER (WHERE notes IS NOT NULL) AS notes,
  max_by(reason, ord) FILTER (WHERE reason IS NOT NULL) AS reason FROM checked WHERE error IS NULL GROUP BY uc_id) p USING (uc_id),
 LATERAL (SELECT CASE WHEN p.status = 'completed' AND coalesce(f.computed_status, '') <> 'completed' THEN 'manual_completion' WHEN f.computed_status IS NOT NULL AND p.status <> f.computed_status THEN 'status_override' END AS kind,
  p.uc_id IS NOT NULL AND f.computed_status IS NULL AND EXISTS (SELECT 1 FROM finds x WHERE x.user_id = f.user_id AND x.item_id = f.challenge_id) AS auto)"""
WITH_UC = with_tables("enrolments", "challenges", "items", "finds", "users", extra={"full_uc": FULL, "patches": PATCHES, "checked": CHECKED})


def create_missing(t):
    return e.missing_counts(t.users(), t.challenges(), t.enrolments())


def sync_enrolments(t):
    return e.sync_counts(t.users(), t.challenges(), t.enrolments(), t.finds())


def sync_enrolments_merged(t):
    """The whole enrolment table after completing what users have found."""
    return e.sync(_full(t), t.challenges(), t.finds())


def autocomplete(t):
    return e.autocomplete(_full(t), t.challenges(), t.finds()).select("uc_id", "user_id", "computed_status", "percent")


def reset(t):
    return e.reset(_full(t), t.enrolments().where("seed % 4 = 1"))


def patch_results(t):
    return e.check_patches(_full(t), patches(t)).select("uc_id", "user_id", "ord", "ok", "error")


def patch_enrolments(t):
    return e.apply_patches(_full(t), patches(t), t.challenges(), t.finds(), FIXED_AS_OF)


def override_kinds(t):
    rows = e.check_patches(_full(t), patches(t))
    return rows.select("uc_id", "ord", e.override_kind(F.col("status"), F.col("computed")).alias("override_kind"))


def bulk_set_status(t):
    return e.set_status(_full(t), t.enrolments().where("seed % 4 = 1"), "completed", FIXED_AS_OF)


def effective_status(t):
    return _full(t).select("uc_id", e.effective_status().alias("effective_status"))


def filter_by_status(t):
    full = _full(t)
    flags = [F.when(e.has_status(s), F.lit(s)) for s in e.STATUSES]
    return full.select("uc_id", F.explode(F.array_compact(F.array(*flags))).alias("matches"))


def list_enrolments(t):
    rows = e.list_page(_full(t), t.challenges(), t.items(), status="accepted", page=1, size=2)
    return rows.select("user_id", "uc_id", "challenge_name", "item_code", "effective_status", "updated_at", "position", "nb_items", "nb_pages")


def enrolment_detail(t):
    rows = e.detail(_full(t), t.challenges(), t.items())
    return rows.select("uc_id", "user_id", "status", "computed_status", "effective_status", "challenge_name", "item_code", "difficulty", "terrain", "lat", "lon", "percent", "notes")


def replace_tasks(t):
    payload = t.enrolments().where("seed % 3 = 0").selectExpr("uc_id", "user_id", "explode(array(0, 1, 2)) AS position").selectExpr(
        "*", "uc_id * 10 + position + 5000000000000000 AS task_id", "CASE WHEN position = 1 THEN 7 END AS ord", "CASE WHEN position = 2 THEN 'own title' END AS title",
        "position AS rule_id", "1 AS min_count", "CASE WHEN position = 0 THEN 'in_progress' END AS status",
    )
    return e.replace_tasks(t.tasks(), payload)


def list_tasks(t):
    return e.list_tasks(t.tasks()).select("task_id", "uc_id", "ord", "title", "position", "status")


EFFECTIVE = "CASE WHEN status = 'completed' OR computed_status = 'completed' THEN 'completed' ELSE coalesce(status, 'pending') END"
NOT_DONE = "coalesce(computed_status, '') <> 'completed'"
MISSING = """SELECT user_id, count(e.uc_id) AS existing, (SELECT count(*) FROM challenges) - count(e.uc_id) AS created, (SELECT count(*) FROM challenges) AS total
 FROM users LEFT JOIN enrolments e USING (user_id) GROUP BY user_id"""
ITEMS = with_tables("items", "challenges", "finds", extra={"batch": ITEM_BATCH})
FINDS = with_tables("items", "finds", extra={"stored": STORED, "fbatch": FIND_BATCH})
MARKED = "SELECT item_id AS challenge_id, item_id, title AS name, description FROM items WHERE item_id % 40 = 3 AND item_id % 80 <> 3"

CHECKS = {
    "upsert_items": (_q(upsert_items), ITEMS + MERGED_ITEMS),
    "upsert_items_counts": (
        _q(upsert_items_counts),
        ITEMS + f"SELECT count(*) FILTER (WHERE change = 'inserted') AS inserted, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) AS total FROM ({MERGED_ITEMS})",
    ),
    "upsert_finds": (
        _q(upsert_finds),
        FINDS
        + """SELECT coalesce(s.user_id, b.user_id) AS user_id, coalesce(s.item_id, b.item_id) AS item_id, coalesce(s.found_date, b.found_date) AS found_date,
 CASE WHEN b.notes_present THEN b.notes ELSE s.notes END AS notes, CASE WHEN s.user_id IS NULL THEN 'inserted' WHEN b.user_id IS NULL THEN 'kept' ELSE 'updated' END AS change
 FROM stored s FULL JOIN fbatch b ON s.user_id = b.user_id AND s.item_id = b.item_id""",
    ),
    "existing_items_by_code": (
        _q(existing_items_by_code),
        FINDS + "SELECT code, item_id FROM items WHERE item_id IN (SELECT item_id FROM finds WHERE item_id % 3 = 0 UNION SELECT item_id + 1 FROM finds WHERE item_id % 3 = 0)",
    ),
    "count_existing_finds": (
        _q(count_existing_finds),
        FINDS + "SELECT user_id, count(*) AS existing FROM finds WHERE (user_id, item_id) IN (SELECT (user_id, item_id) FROM fbatch) GROUP BY user_id",
    ),
    "extract_codes_from_text": (_q(extract_codes), with_tables("finds") + CODES.replace(" WHERE item_id % 3 > 0", "")),
    "sync_finds_full": (
        _q(sync_finds_full),
        with_tables("items", "finds", extra=SYNC)
        + """SELECT user_id, count(*) FILTER (WHERE action <> 'delete') AS nb_provided, count(*) FILTER (WHERE action = 'add') AS nb_added,
 count(*) FILTER (WHERE action = 'delete') AS nb_deleted, count(*) FILTER (WHERE action = 'unknown') AS nb_unknown FROM act GROUP BY user_id""",
    ),
    "sync_finds_unknown": (_q(sync_unknown), with_tables("items", "finds", extra=SYNC) + "SELECT user_id, code FROM res WHERE item_id IS NULL"),
    "sync_finds_applied": (
        _q(sync_applied),
        with_tables("items", "finds", extra={**SYNC, "stored": STORED})
        + f"""SELECT user_id, item_id, found_date, notes FROM stored s WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.action = 'delete' AND a.user_id = s.user_id AND a.item_id = s.item_id)
 UNION ALL SELECT user_id, item_id, DATE '{FIXED_AS_OF}', NULL FROM act WHERE action = 'add'""",
    ),
    "create_challenges": (_q(create_challenges), ITEMS + MARKED),
    "create_challenges_subset": (_q(create_challenges_subset), ITEMS + MARKED + " AND item_id IN (SELECT item_id FROM finds)"),
    "create_challenges_counts": (
        _q(create_challenges_counts),
        ITEMS + "SELECT count(*) AS matched, count(*) FILTER (WHERE item_id % 80 <> 3) AS created, count(*) FILTER (WHERE item_id % 80 = 3) AS skipped FROM items WHERE item_id % 40 = 3",
    ),
    "create_missing_enrolments": (_q(create_missing), WITH_UC + MISSING),
    "sync_enrolments": (
        _q(sync_enrolments),
        WITH_UC
        + f"""SELECT m.*, coalesce(n, 0) AS auto_completed FROM ({MISSING}) m LEFT JOIN (SELECT e.user_id, count(*) AS n FROM enrolments e
 JOIN finds f ON f.user_id = e.user_id AND f.item_id = e.challenge_id WHERE coalesce(e.computed_status,'') <> 'completed' AND e.status <> 'completed' GROUP BY e.user_id) USING (user_id)""",
    ),
    "sync_enrolments_merged": (
        _q(sync_enrolments_merged),
        WITH_UC
        + """SELECT e.* EXCLUDE (hit) REPLACE (CASE WHEN hit THEN 'completed' ELSE computed_status END AS computed_status, CASE WHEN hit THEN 100.0::DOUBLE ELSE percent END AS percent),
 false AS created, hit AS auto_completed FROM (SELECT u.*, EXISTS (SELECT 1 FROM finds f JOIN challenges c USING (item_id) WHERE f.user_id = u.user_id AND c.challenge_id = u.challenge_id)
 AND coalesce(computed_status,'') <> 'completed' AND coalesce(status,'') <> 'completed' AS hit FROM full_uc u) e""",
    ),
    "autocomplete_enrolments": (
        _q(autocomplete),
        WITH_UC
        + """SELECT uc_id, e.user_id, 'completed' AS computed_status, 100.0::DOUBLE AS percent FROM full_uc e JOIN finds f ON f.user_id = e.user_id AND f.item_id = e.challenge_id
 WHERE coalesce(e.computed_status,'') <> 'completed' AND coalesce(e.status,'') <> 'completed'""",
    ),
    "reset_enrolments": (
        _q(reset),
        WITH_UC
        + """SELECT uc_id, user_id, challenge_id, seed, CASE WHEN seed % 4 = 1 THEN 'pending' ELSE status END AS status, CASE WHEN seed % 4 <> 1 THEN computed_status END AS computed_status,
 CASE WHEN seed % 4 <> 1 THEN notes END AS notes, CASE WHEN seed % 4 <> 1 THEN manual_override END AS manual_override, CASE WHEN seed % 4 <> 1 THEN override_reason END AS override_reason,
 CASE WHEN seed % 4 <> 1 THEN percent END AS percent, updated_at FROM full_uc""",
    ),
    "validate_transition": (_q(patch_results), WITH_UC + "SELECT uc_id, user_id, ord, error IS NULL AS ok, error FROM checked"),
    "patch_enrolments": (_q(patch_enrolments), WITH_UC + APPLIED),
    "override_kind": (
        _q(override_kinds),
        WITH_UC
        + """SELECT uc_id, ord, CASE WHEN status = 'completed' AND coalesce(computed,'') <> 'completed' THEN 'manual_completion' WHEN computed IS NOT NULL AND status <> computed THEN 'status_override' END AS override_kind FROM checked""",
    ),
    "bulk_set_status": (
        _q(bulk_set_status),
        WITH_UC
        + f"""SELECT uc_id, user_id, challenge_id, seed, CASE WHEN c THEN 'completed' ELSE status END AS status, computed_status, notes, c OR manual_override AS manual_override,
 CASE WHEN c THEN 'Manual completion' ELSE override_reason END AS override_reason, CASE WHEN c THEN 100.0 ELSE percent END AS percent,
 CASE WHEN c THEN DATE '{FIXED_AS_OF}' ELSE updated_at END AS updated_at FROM (SELECT *, seed % 4 = 1 AS c FROM full_uc)""",
    ),
    "effective_status": (_q(effective_status), WITH_UC + f"SELECT uc_id, {EFFECTIVE} AS effective_status FROM full_uc"),
    "filter_by_status": (
        _q(filter_by_status),
        WITH_UC
        + f"""SELECT uc_id, 'completed' AS matches FROM full_uc WHERE status = 'completed' OR computed_status = 'completed'
 UNION ALL SELECT uc_id, status FROM full_uc WHERE status IN ('accepted','dismissed') AND {NOT_DONE}
 UNION ALL SELECT uc_id, 'pending' FROM full_uc WHERE (status IS NULL OR status = 'pending') AND {NOT_DONE}""",
    ),
    "list_enrolments": (
        _q(list_enrolments),
        WITH_UC
        + f"""SELECT f.user_id, uc_id, c.name AS challenge_name, i.code AS item_code, 'accepted' AS effective_status, updated_at,
 CAST(row_number() OVER (PARTITION BY f.user_id ORDER BY updated_at DESC, uc_id) AS INT) AS position, count(*) OVER (PARTITION BY f.user_id) AS nb_items,
 CAST(ceil(count(*) OVER (PARTITION BY f.user_id) / 2) AS BIGINT) AS nb_pages FROM full_uc f JOIN challenges c USING (challenge_id) LEFT JOIN items i ON i.item_id = c.item_id
 WHERE f.status = 'accepted' AND {NOT_DONE} QUALIFY position <= 2""",
    ),
    "enrolment_detail": (
        _q(enrolment_detail),
        WITH_UC
        + f"""SELECT uc_id, user_id, f.status, computed_status, CASE WHEN f.status = 'completed' OR computed_status = 'completed' THEN 'completed' ELSE coalesce(f.status, 'pending') END AS effective_status,
 c.name AS challenge_name, i.code AS item_code, difficulty, terrain, lat, lon, percent, notes FROM full_uc f JOIN challenges c USING (challenge_id) LEFT JOIN items i ON i.item_id = c.item_id""",
    ),
    "replace_tasks": (
        _q(replace_tasks),
        with_tables("tasks")
        + """SELECT * FROM tasks WHERE uc_id NOT IN (SELECT uc_id FROM enrolments WHERE seed % 3 = 0)
 UNION ALL SELECT uc_id * 10 + p + 5000000000000000, uc_id, user_id, CAST(CASE WHEN p = 1 THEN 7 ELSE p END AS INT), CASE WHEN p = 2 THEN 'own title' ELSE concat('Task #', p + 1) END,
 CAST(p AS INT), 1, CASE WHEN p = 0 THEN 'in_progress' ELSE 'todo' END FROM enrolments, (SELECT unnest([0,1,2]) AS p) WHERE seed % 3 = 0""",
    ),
    "list_tasks": (
        _q(list_tasks),
        with_tables("tasks")
        + "SELECT task_id, uc_id, ord, coalesce(title, 'Untitled task') AS title, CAST(row_number() OVER (PARTITION BY uc_id ORDER BY ord, task_id) AS INT) AS position, status FROM tasks",
    ),
}
