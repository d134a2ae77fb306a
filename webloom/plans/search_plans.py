"""Search, word statistics and classification of text."""

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators import nearest as N
from webloom.operators import terms as W
from webloom.operators.joins import fits_broadcast, lookup
from webloom.plans.registry import query
from webloom.plans.text_plans import ALNUM_SQL, WORDS_SQL

KEYWORD = "tion"
STOP = ("the", "of", "and", "a", "in", "to", "is", "it", "that", "for", "on", "are", "as", "with", "by", "at", "this", "be", "from", "or", "an", "not", "was",
        "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "dans", "pour", "par", "sur", "pas", "est", "avec",
        "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "des", "ein", "für", "auf", "im", "sich", "als", "nicht")
BAG = f"bag as (select doc_id, term, count(*) as tf from (select doc_id, unnest({WORDS_SQL}) as term from documents) group by all)"
VOCAB = "vocab as (select term, cast(sum(tf) as bigint) as total_count, count(*) as total_docs from bag group by term having sum(tf) >= 5)"


def words():
    return T.tokenize_words(F.col("text"))


@query("search_keyword", r"""
select page_id, regexp_matches(html, '(?i)tion') as found,
  regexp_replace(regexp_extract(html, '(?i)(<[^<]+)(tion)([^>]+>)', 0), '[\r\n]', '', 'g') as context from pages""")
def search_keyword(t):
    from webloom.operators.search import search_keyword as run
    return run(t.pages, KEYWORD)


@query("search_regex", r"""
select page_id, regexp_matches(html, 'href="/[A-Z]\w+"') as found,
  regexp_extract(html, 'href="/[A-Z]\w+"', 0) as context from pages""")
def search_regex(t):
    from webloom.operators.search import search_regex as run
    return run(t.pages, r'href="/[A-Z]\w+"')


MAIL_RE2 = T.EMAIL_PATTERN.replace("'", "''").replace(r"\/", "/")


@query("search_email", f"""
with m as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{MAIL_RE2}', 1))) as mail from documents)
select doc_id, mail from m where not contains(mail, 'example.org')""")
def search_email(t):
    mails = T.find_emails(F.lower("text"), ("example.org",))
    return t.documents.select("doc_id", F.explode(mails).alias("mail"))


@query("language_filter", "select doc_id, lang, n_chars from documents where lang = 'en'")
def language_filter(t):
    return t.documents.filter("lang = 'en'").select("doc_id", "lang", "n_chars")


@query("record_text_filter", r"""with hit as (select conv_id from conversations group by conv_id having bool_or(regexp_matches(text, '[A-Z]\w+tion')))
  select conv_id, turn, role from conversations where conv_id in (select conv_id from hit)""")
def record_text_filter(t):
    from webloom.operators.search import record_text_filter as run
    return run(t.conversations, "conv_id", F.col("text").rlike(r"[A-Z]\w+tion")).select("conv_id", "turn", "role")


@query("bag_of_words", f"with {BAG} select doc_id, term, tf from bag")
def bag_of_words(t):
    return W.bag_of_words(t.documents, words())


@query("word_presence", f"with {BAG} select doc_id, term, 1::bigint as tf from bag")
def word_presence(t):
    return W.bag_of_words(t.documents, words(), count=False)


@query("term_counts", f"with {BAG} select term, cast(sum(tf) as bigint) as total_count, count(*) as total_docs from bag group by term")
def term_counts(t):
    return W.term_counts(t.documents, words())


@query("min_count_filter", f"with {BAG}, {VOCAB} select term, total_count, total_docs, row_number() over (order by term) - 1 as pos from vocab")
def min_count_filter(t):
    return W.vocabulary(t.documents, words())


@query("known_only", f"with {BAG}, {VOCAB} select doc_id, term, tf from bag where term in (select term from vocab where total_docs < 50)")
def known_only(t):
    rare = W.vocabulary(t.documents, words()).filter("total_docs < 50")
    return W.known_only(W.bag_of_words(t.documents, words()), rare, "term").select("doc_id", "term", "tf")


@query("tfidf", f"""with {BAG}, {VOCAB} select doc_id, term,
  round(ln(1 + tf::double / total_count) * ln((select count(*) from documents)::double / total_docs + 1), 9) as weight from bag join vocab using (term)""")
def tfidf(t):
    return W.tfidf(t.documents, words()).withColumn("weight", F.round("weight", 9))


@query("sentence_docs", "with s as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, line from s where line <> ''")
def sentence_docs(t):
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


ALNUM_BAG = f"bag as (select doc_id, term, count(*) as tf from (select doc_id, unnest({ALNUM_SQL}) as term from documents) group by all)"
UNIT = "unit as (select doc_id, term, tf / sqrt(sum(tf * tf) over (partition by doc_id)) as weight from bag)"


def unit(t):
    return W.unit_weights(W.bag_of_words(t.documents, T.tokenize_alnum(F.col("text"))))


@query("unit_normalize", f"with {ALNUM_BAG}, {UNIT} select doc_id, term, round(weight, 9) as weight from unit")
def unit_normalize(t):
    return unit(t).withColumn("weight", F.round("weight", 9))


@query("posting_list_join", f"""with {ALNUM_BAG}, {UNIT},
  qb as (select item_id, term, count(*) as tf from (select item_id, unnest({ALNUM_SQL}) as term from benchmark) group by all),
  q as (select item_id, term, tf / sqrt(sum(tf * tf) over (partition by item_id)) as weight from qb),
  s as (select q.item_id as query_id, unit.doc_id as item_id, round(sum(q.weight * unit.weight), 9) as score from q join unit using (term) group by all)
  select query_id, item_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, item_id) as rank from s qualify rank <= 10""")
def posting_list_join(t):
    """Ten documents with the largest dot product for every benchmark text."""
    bench = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    asked = W.unit_weights(W.bag_of_words(bench, T.tokenize_alnum(F.col("text"))))
    found = N.nearest_documents(N.packed(asked), N.packed(unit(t)), 10)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


KNN = f"""{ALNUM_BAG}, {UNIT}, s as (select q.doc_id as query_id, d.doc_id as item_id, round(sum(q.weight * d.weight), 9) as score
   from unit q join unit d using (term) join labels l on l.doc_id = d.doc_id where d.doc_id % 5 <> 0
   and q.doc_id in (select doc_id from labels where doc_id % 5 = 0) group by all),
  top as (select query_id, item_id, score from s qualify row_number() over (partition by query_id order by score desc, item_id) <= 5),
  votes as (select query_id, quality, count(*) as votes from top join labels on labels.doc_id = item_id group by all)"""


@query("knn_classify", f"with {KNN} select query_id, cast(quality as int) as class from votes qualify row_number() over (partition by query_id order by votes desc, quality) = 1")
def knn_classify(t):
    """Quality class of every fifth labelled document from its five nearest labelled ones."""
    ids = t.labels.select("doc_id")
    # Joined by key, all texts would be shuffled, and those with labels once more.
    labelled = lookup(t.documents, ids, "doc_id", "left_semi", small=fits_broadcast(ids, rows=2**22))
    weights = W.unit_weights(W.bag_of_words(labelled, T.tokenize_alnum(F.col("text"))))
    vectors = N.packed(weights)
    near = N.nearest_documents(vectors.filter("id % 5 = 0"), vectors.filter("id % 5 <> 0"), 5)
    return N.majority_class(near, t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("class")))


@query("mode_vote", """with c as (select source, lang, count(*) as n from documents group by all)
  select source, lang from c qualify row_number() over (partition by source order by n desc, lang) = 1""")
def mode_vote(t):
    counts = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = F.min_by("lang", F.struct(-F.col("n"), F.col("lang")))
    return counts.groupBy("source").agg(best.alias("lang"))


STOP_SQL = "|".join(sorted(set(STOP), key=lambda w: (-len(w), w)))


@query("rake_keywords", rf"""
with w as (select doc_id, generate_subscripts(x, 1) as place, unnest(x) as tok from (select doc_id, regexp_extract_all(lower(text),
    '[\p{{L}}\p{{N}}'']+|[^\p{{L}}\p{{N}}'' ]+') as x from documents)),
 m as (select *, regexp_matches(tok, '^({STOP_SQL})$') or not regexp_matches(tok, '[\p{{L}}\p{{N}}'']') as brk from w),
 g as (select *, sum(case when brk then 1 else 0 end) over (partition by doc_id order by place) as part from m),
 p as (select doc_id, part, string_agg(tok, ' ' order by place) as phrase, count(*) as size from g where not brk group by all),
 v as (select g.doc_id, g.part, phrase, size, tok as word from g join p using (doc_id, part) where not brk),
 s as (select doc_id, part, phrase, sum(size) over (partition by doc_id, word) / count(*) over (partition by doc_id, word) as ws from v),
 t as (select doc_id, part, phrase, sum(ws) as score from s group by all)
select doc_id, phrase, round(max(score), 6) as score from t group by all""")
def rake_keywords(t):
    return W.rake_keywords(t.documents, tuple(sorted(set(STOP))))


DICT = r"""pairs as (select lower(regexp_extract(text, '^\w{2,8}')) as keyword, lang as category from documents where regexp_matches(text, '^\w{2,8}')),
  dict as (select keyword, min(category) as category from (select * from pairs union all select lower(category), lower(category) from pairs) group by keyword)"""


def dictionary(t):
    from webloom.sources.files import keyword_dictionary
    first = F.regexp_extract("text", r"\A\w{2,8}", 0)
    return keyword_dictionary(t.documents.select(first.alias("keyword"), F.col("lang").alias("category")).filter("keyword <> ''"))


@query("keyword_dictionary", f"with {DICT} select keyword, category from dict")
def keyword_dictionary(t):
    return dictionary(t)


@query("keyword_category_join", f"with {DICT} select distinct page_id, category from pages join dict on contains(lower(url), keyword)")
def keyword_category_join(t):
    return W.keyword_categories(t.pages, dictionary(t), "page_id", "url")


@query("distinct_set", f"""with {DICT}, h as (select distinct page_id, category from pages join dict on contains(lower(url), keyword))
  select page_id, string_agg(category, ',' order by category) as categories from h group by page_id""")
def distinct_set(t):
    """At most one entry per category of the dictionary in each set."""
    hits = W.keyword_categories(t.pages, dictionary(t), "page_id", "url")
    return hits.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("search_top10", f"""with {BAG}, p as (select * from bag where term in ('treater', 'tions', 'which', 'there', 'entre', 'einen', 'tioned')),
  d as (select term, count(*) as df from p group by term)
  select doc_id, round(sum(tf * ln((select count(*) from documents)::double / df + 1)), 6) as score from p join d using (term) group by doc_id
  order by score desc, doc_id limit 10""")
def search_top10(t):
    return W.search_top(t.documents, words(), ["treater", "tions", "which", "there", "entre", "einen", "tioned"], 10)
