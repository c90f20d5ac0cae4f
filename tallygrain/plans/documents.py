"""Articles, movies and customer documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.scalars import as_array
from tallygrain.operators import documents, joins, postings, predicates, schemaless, topk
from tallygrain.operators.aggregates import collect_chunks, collect_ordered, count_by
from tallygrain.operators.ordered import block_of
from tallygrain.plans.relational import SHARE_SQL, title_index
from tallygrain.registry import query
from tallygrain.session import work_folder, written
from tallygrain.shapes import shape

ROWS = 256  # elements per chunk of a document array
ID_BLOCK = 1 << 16


# --- articles --------------------------------------------------------------------------
def article_documents(articles: DataFrame, categories: DataFrame, comments: DataFrame, people: DataFrame) -> DataFrame:
    """Flat article tables as documents ``(article_id, chunk, categories, comments, peoples)``.

    Categories are a small closed vocabulary and stay in chunk 0; people, like comments, fill as many chunks as they need.
    """
    names = categories.groupBy("article_id").agg(F.array_sort(F.collect_set("name")).alias("categories"))
    # written, as it is read for the splitters and again for the arrays
    persons = collect_ordered(
        written(people.distinct(), "people"), ["article_id"], ["name"], ["name"], "peoples", rows=ROWS
    ).withColumn("peoples", F.col("peoples.name"))
    zero = F.lit(0).cast("long").alias("chunk")
    return documents.assemble(
        articles.select("article_id"),
        "article_id",
        {
            "comments": collect_chunks(comments, ["article_id"], "idx", ["name", "comment"], "comments", ROWS),
            "categories": names.select("article_id", zero, "categories"),
            "peoples": persons,
        },
    )


def load_articles(spark, sf) -> DataFrame:
    comments = shape(spark, sf, "art_comments")
    return article_documents(
        shape(spark, sf, "art_articles"), shape(spark, sf, "art_categories"), comments, comments.select("article_id", "name")
    )


def stored_articles(spark, sf) -> DataFrame:
    """The documents as a stored collection, for queries that read it more than once."""
    return written(load_articles(spark, sf), "articles")


def _comments_json():
    return F.to_json("comments", {"ignoreNullFields": "false"})


@query(
    "json_unnest_group",
    "select name, count(*) as n from (select distinct article_id, name from art_comments) group by name",
)
def json_unnest_group(spark, sf):
    articles = load_articles(spark, sf).filter("chunk = 0 or size(peoples) > 0")
    return documents.unnest_count(articles, "peoples", None)


@query(
    "json_unnest_measure",
    """select name, count(*) as total_articles, cast(sum(n_comments) as bigint) as total_comments
       from (select distinct article_id, name from art_categories) right join art_articles using (article_id) group by name""",
)
def json_unnest_measure(spark, sf):
    return documents.unnest_measure(stored_articles(spark, sf), "article_id", "categories", "comments")


@query(
    "json_array_size_top",
    "select article_id, n_comments as n from art_articles order by n desc, article_id limit 10",
)
def json_array_size_top(spark, sf):
    return documents.largest_arrays(load_articles(spark, sf), "article_id", "comments", 10)


# documents with their comments in chunks of 256; the other arrays sit in chunk 0
ARTICLE_SQL = """
  chunks as (select article_id, idx // 256 as chunk, list(struct_pack(name := name, comment := comment) order by idx) as comments
             from art_comments group by all),
  arts as (select k.*,
             case when chunk = 0 then (select coalesce(list(distinct c.name order by c.name), []) from art_categories c where c.article_id = k.article_id)
                  else [] end as categories,
             case when chunk = 0 then (select list(distinct m.name order by m.name) from art_comments m where m.article_id = k.article_id)
                  else [] end as peoples
           from chunks k)"""


@query(
    "duality_assemble",
    f"""with {ARTICLE_SQL}
        select article_id, to_json(struct_pack(_id := article_id, categories := categories, peoples := peoples, comments := comments))::varchar as doc
        from arts""",
)
def duality_assemble(spark, sf):
    flat = {n: shape(spark, sf, f"art_{n}") for n in ("articles", "categories", "comments", "people", "people_articles")}
    people = flat["people_articles"].join(flat["people"], F.col("people_id") == F.col("id")).select("article_id", "name")
    docs = article_documents(flat["articles"], flat["categories"], flat["comments"], people)
    text = documents.to_document(
        {"_id": "article_id", "categories": "categories", "peoples": "peoples", "comments": "comments"}
    )
    return docs.select("article_id", text.alias("doc"))


@query(
    "duality_shred",
    """select 'comments' as table_name, article_id, idx::bigint as idx, name || ': ' || comment as value from art_comments
       union all select 'categories', article_id, row_number() over (partition by article_id order by name) - 1, name
         from (select distinct article_id, name from art_categories)
       union all select 'peoples', article_id, row_number() over (partition by article_id order by name) - 1, name
         from (select distinct article_id, name from art_comments)""",
)
def duality_shred(spark, sf):
    tables = documents.shred(stored_articles(spark, sf), "article_id", ["comments", "categories", "peoples"], ROWS)
    text = {"comments": F.concat(F.col("value.name"), F.lit(": "), F.col("value.comment"))}
    parts = [
        df.select(F.lit(name).alias("table_name"), "article_id", "idx", text.get(name, F.col("value")).alias("value"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "json_set",
    """with last as (select article_id, arg_max(comment, idx) as v from art_comments where name = 'user' group by 1)
       select article_id, to_json(struct_pack(id := article_id, title := coalesce(v, 'none')))::varchar as doc
       from art_articles left join last using (article_id)""",
)
def json_set(spark, sf):
    docs = shape(spark, sf, "art_articles").select(
        "article_id", F.struct(F.col("article_id").alias("id"), F.lit("none").alias("title")).alias("doc")
    )
    changes = shape(spark, sf, "art_comments").filter("name = 'user'")
    edited = documents.doc_set(docs, changes, "article_id", "title", "comment", ["idx"])
    return edited.select("article_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("doc"))


# the batch of appended comments: one per event of users that are also article ids
@query(
    "json_append",
    """with new as (select user_id as article_id, event_id, event_type, n_comments
                      + row_number() over (partition by user_id order by event_id) - 1 as i
                    from events join art_articles on article_id = user_id),
            allc as (select article_id, idx as i, name, comment, cast(null as varchar) as url from art_comments
                     union all select article_id, i, event_type, 'event ' || event_id, './articles/' || article_id || '/comments/' || i from new)
       select article_id, cast(i // 256 as bigint) as chunk,
              to_json(list(struct_pack(name := name, comment := comment, url := url) order by i))::varchar as comments
       from allc group by all""",
)
def json_append(spark, sf):
    docs = stored_articles(spark, sf).withColumn(
        "comments",
        F.transform("comments", lambda c: F.struct(c["name"].alias("name"), c["comment"].alias("comment"),
                                                   F.lit(None).cast("string").alias("url"))),
    )
    events = shape(spark, sf, "events").select(F.col("user_id").alias("article_id"), "event_id", "event_type")

    def fields(i):
        # fixed values: the names of a comment's fields and the form of its url
        return [
            F.col("event_type").alias("name"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("comment"),
            F.concat(F.lit("./articles/"), F.col("article_id").cast("string"), F.lit("/comments/"), i.cast("string")).alias("url"),
        ]

    edited = documents.doc_append(
        docs, events, "article_id", "comments", ["event_id"], [block_of("event_id", ID_BLOCK)], fields, ROWS
    )
    return edited.select("article_id", "chunk", _comments_json().alias("comments"))


@query(
    "json_set_element",
    """with ch as (select user_id as article_id, event_id % 4 as i, arg_max(event_type || ' ' || event_id, event_id) as v
                   from events group by all)
       select m.article_id, m.idx // 256 as chunk,
              to_json(list(struct_pack(name := name, comment := coalesce(v, comment)) order by idx))::varchar as comments
       from art_comments m left join ch on ch.article_id = m.article_id and ch.i = m.idx group by all""",
)
def json_set_element(spark, sf):
    changes = shape(spark, sf, "events").select(
        F.col("user_id").alias("article_id"), (F.col("event_id") % 4).alias("i"), "event_id",
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("v"),
    )
    edited = documents.doc_set_element(
        load_articles(spark, sf), changes, "article_id", "comments", "i", "comment", "v", ["event_id"], ROWS
    )
    return edited.select("article_id", "chunk", _comments_json().alias("comments"))


@query(
    "json_remove_element",
    """with gone as (select distinct user_id as article_id, event_id % 7 as i from events where event_type = 'error'),
            kept as (select article_id, name, comment, row_number() over (partition by article_id order by idx) - 1 as i
                     from art_comments m
                     where not exists (select 1 from gone g where g.article_id = m.article_id and g.i = m.idx)),
            chunks as (select article_id, i // 256 as chunk,
                              to_json(list(struct_pack(name := name, comment := comment) order by i))::varchar as comments
                       from kept group by all)
       select article_id, chunk, coalesce(comments, '[]') as comments
       from (select distinct article_id, 0::bigint as chunk from art_comments union select article_id, chunk from chunks)
            left join chunks using (article_id, chunk)""",
)
def json_remove_element(spark, sf):
    gone = shape(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("user_id").alias("article_id"), (F.col("event_id") % 7).alias("i")
    )
    edited = documents.doc_remove_element(load_articles(spark, sf), gone, "article_id", "comments", "i", ROWS)
    return edited.select("article_id", "chunk", _comments_json().alias("comments"))


@query(
    "scalar_to_array",
    """select event_id, case event_type when 'error' then '[]' when 'view' then '[' || (props::json)::varchar || ']'
                        else '[' || (props::json)::varchar || ',' || (props::json)::varchar || ']' end as history,
              case event_type when 'error' then 0 when 'view' then 1 else 2 end as n
       from (select event_id, event_type, '{"k":' || (props::json->>'k') || '}' as props from events)""",
)
def scalar_to_array(spark, sf):
    events = shape(spark, sf, "events").select("event_id", "event_type", "props")
    # absent for errors, a single object for views, an array otherwise
    raw = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", F.col("props"))
        .otherwise(F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]")))
    )
    history = as_array(raw, "struct<k:bigint>")
    return events.select("event_id", F.to_json(history).alias("history"), F.size(history).alias("n"))


@query(
    "json_path",
    "select event_id, cast(props->>'$.k' as bigint) as k, cast(props->>'$.missing' as bigint) as missing from events",
)
def json_path(spark, sf):
    return shape(spark, sf, "events").select(
        "event_id",
        documents.json_value("props", "$.k", "bigint").alias("k"),
        documents.json_value("props", "$.missing", "bigint").alias("missing"),
    )


@query(
    "array_param_expand",
    """select conv_id, cast(n as bigint) as part, word as offer from (
         select conv_id, turn as n, unnest(string_split(text, ' ')) as word from conversations)""",
)
def array_param_expand(spark, sf):
    offers = shape(spark, sf, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("part"), F.split("text", " ").alias("offers")
    )
    return documents.expand_offers(offers, "offers", "offer")


# --- named article queries -----------------------------------------------------------------
@query(
    "doc_articles_per_person",
    """select p.name, count(*) as n, 'tables' as form from art_people p join art_people_articles a on a.people_id = p.id group by 1
       union all select name, count(*), 'documents' from (select distinct article_id, name from art_comments) group by 1""",
)
def doc_articles_per_person(spark, sf):
    people, bridge = shape(spark, sf, "art_people"), shape(spark, sf, "art_people_articles")
    counted = count_by(bridge, ["people_id"]).join(people, F.col("people_id") == F.col("id"))
    flat = counted.groupBy("name").agg(F.sum("n").alias("n")).withColumn("form", F.lit("tables"))
    nested = documents.unnest_count(load_articles(spark, sf).filter("chunk = 0"), "peoples", None)
    return flat.unionByName(nested.withColumn("form", F.lit("documents")))


@query(
    "doc_top_categories",
    """with f as (select name, count(distinct article_id) as a, cast(sum(n_comments) as bigint) as c
                  from art_categories join art_articles using (article_id) group by 1 order by a desc, c desc, name limit 10),
            d as (select name, count(*) as a, cast(sum(n_comments) as bigint) as c
                  from (select distinct article_id, name from art_categories) right join art_articles using (article_id)
                  group by 1 order by a desc, c desc, name nulls last limit 10)
       select 'tables' as form, name, a as total_articles, c as total_comments from f
       union all select 'documents', name, a, c from d""",
)
def doc_top_categories(spark, sf):
    """Top categories by articles, then comments, from the flat tables and from the documents."""
    order = [F.desc("total_articles"), F.desc("total_comments"), F.col("name").asc_nulls_last()]
    sizes = shape(spark, sf, "art_articles")
    per_article = shape(spark, sf, "art_categories").join(sizes, "article_id").groupBy("name", "article_id").agg(
        F.sum("n_comments").alias("n")
    )
    flat = per_article.groupBy("name").agg(F.count(F.lit(1)).alias("total_articles"), F.sum("n").alias("total_comments"))
    nested = documents.unnest_measure(stored_articles(spark, sf), "article_id", "categories", "comments")
    return topk.top_n(flat, order, 10).withColumn("form", F.lit("tables")).unionByName(
        topk.top_n(nested, order, 10).withColumn("form", F.lit("documents"))
    )


@query(
    "doc_top_commented",
    """select article_id, n_comments as n, form from (select * from art_articles order by n_comments desc, article_id limit 10),
       (values ('tables'), ('documents')) f(form)""",
)
def doc_top_commented(spark, sf):
    flat = topk.top_n(count_by(shape(spark, sf, "art_comments"), ["article_id"]), [F.desc("n"), "article_id"], 10)
    nested = documents.largest_arrays(load_articles(spark, sf), "article_id", "comments", 10)
    return flat.withColumn("form", F.lit("tables")).unionByName(nested.withColumn("form", F.lit("documents")))


# --- movies ------------------------------------------------------------------------------------
def movie_document(movies: DataFrame) -> DataFrame:
    """Movie rows as JSON documents, the quoted genre text repaired to an array."""
    text = documents.to_document(
        {"MovieID": "movie_id", "Title": "title", "Genres": "genres", "Year": "year", "Views": F.lit(None).cast("int"),
         "Runtime": "n_chars"}
    )
    return documents.normalise_json_text(movies, ["genres"]).select("movie_id", text.alias("doc"))


MOVIE_DOC = """to_json(struct_pack(MovieID := movie_id, Title := title, Genres := [lang, source], Year := year,
                                   Views := null, Runtime := n_chars))::varchar"""


@query("quoted_json_columns", f"select movie_id, {MOVIE_DOC} as doc from movies")
def quoted_json_columns(spark, sf):
    return movie_document(shape(spark, sf, "movies"))



def _newest():
    return [F.col("year").desc_nulls_last(), F.col("movie_id")]


@query(
    "movie_by_genre",
    f"""with hits as (
          select 'en' as search, * from movies where lang = 'en'
          union all select 'en&src1', * from movies where lang = 'en' and source = 'src1'
          union all select 'de|src2', * from movies where lang = 'de' or source = 'src2'),
        top as (select *, row_number() over (partition by search order by year desc, movie_id) as place from hits)
        select search, place::int as place, movie_id, {MOVIE_DOC} as doc from top where place <= 16""",
)
def movie_by_genre(spark, sf):
    """The newest 16 movies of one genre, of two genres together, and of either, as documents."""
    movies = shape(spark, sf, "movies")
    searches = {"en": (["en"], "&"), "en&src1": (["en", "src1"], "&"), "de|src2": (["de", "src2"], "|")}
    # small rows are ranked; the whole text is joined to the 16 kept per search
    light = movies.select("movie_id", "year", "genres")
    tagged = light.withColumn(
        "search",
        F.explode(F.array_compact(F.array(*[
            F.when(predicates.json_contains("genres", terms, mode), F.lit(name)) for name, (terms, mode) in searches.items()
        ]))),
    )
    kept = topk.browse(tagged, ["search"], _newest(), 16, out="place").select("search", "place", "movie_id")
    kept = written(kept, "found")
    docs = movie_document(movies.join(kept.select("movie_id").distinct(), "movie_id", "left_semi"))
    return kept.join(docs, "movie_id").select("search", "place", "movie_id", "doc")


CAST_SQL = r"list_contains(regexp_split_to_array(lower(title), '[^\p{L}]+'), 'aile')"


@query(
    "movie_by_actor",
    rf"""select movie_id, year, n_chars from movies where {CAST_SQL} order by year desc, movie_id limit 16""",
)
def movie_by_actor(spark, sf):
    """The newest 16 movies with a name in their cast (here the words of the whole text)."""

    def make():
        return postings.build(shape(spark, sf, "movies"), "movie_id", postings.letter_tokens("title", digits=False), "casts")

    found = postings.index_of(spark, sf, "casts", make).search({"aile": (["aile"], "&")})
    movies = shape(spark, sf, "movies").select("movie_id", "year", "n_chars")
    in_cast = joins.semi(movies, found.select(F.col("id").alias("movie_id")), ["movie_id"])
    return topk.top_n(in_cast, _newest(), 16)


@query(
    "movie_by_name",
    r"""select movie_id, year, title from movies where regexp_matches(lower(title), '(^|[^\p{L}\p{N}])eauo')
        order by year desc, movie_id limit 16""",
)
def movie_by_name(spark, sf):
    """The newest 16 movies with a title word starting with the term."""
    movies = shape(spark, sf, "movies")
    found = title_index(spark, sf).search({"eauo*": (predicates.indexed_words("eauo*"), "&")})
    light = joins.semi(movies.select("movie_id", "year"), found.select(F.col("id").alias("movie_id")), ["movie_id"])
    # titles are read for the 16 kept only
    kept = written(topk.top_n(light, _newest(), 16), "found")
    return topk.top_n(joins.with_details(kept, movies.select("movie_id", "title"), ["movie_id"]), _newest(), 16)


@query(
    "movie_browse",
    f"""with drawn as (select source from (select distinct source from movies) order by md5(source || '|5'), source limit 4)
        select movie_id, year, source from movies where source in (select source from drawn) and {SHARE_SQL.format(seed=5)} < 0.1""",
)
def movie_browse(spark, sf):
    """A tenth of the movies of four drawn genres."""
    movies = shape(spark, sf, "movies").select("movie_id", "year", "source", F.lit("all").alias("_s"))
    tenth = topk.sample_by(movies, "_s", {"all": 0.1}, "movie_id", seed=5).drop("_s")
    drawn = topk.random_n(movies.select("source").distinct(), "source", 4, seed=5)
    return tenth.join(drawn, "source", "left_semi")


# --- customer documents ---------------------------------------------------------------------------
def customer_children(spark, sf) -> dict[str, DataFrame]:
    """Payment methods, devices and friends of each customer as ordered chunks."""
    # fixed values: the field names PaymentInformationId, Provider, ExpiryDate, DeviceId, AccessCount, FriendFamilyId and
    # CustomerTarget, and the arrays PaymentInfo, DeviceInfo and FriendsAndFamily
    cards = shape(spark, sf, "oe_cards").select(
        F.col("customer_id").alias("cust_id"), F.col("card_id").alias("PaymentInformationId"),
        F.col("card_type").alias("Provider"), F.add_months("issued", 36).alias("expiry"),
    )
    # latest expiry first: order by the negated day number
    cards = cards.withColumn("_day", -F.unix_date("expiry")).withColumn("ExpiryDate", F.col("expiry").cast("string"))
    devices = shape(spark, sf, "devices").select(
        "cust_id", F.col("device_id").alias("DeviceId"), F.col("access_count").alias("AccessCount"),
        (-F.unix_micros(F.col("last_access").cast("timestamp"))).alias("_last"),
    )
    friends = shape(spark, sf, "oe_orders").filter("order_mode = '5-LOW'").select(
        F.col("customer_id").alias("cust_id"), F.col("order_id").alias("FriendFamilyId"),
        F.col("sales_rep_id").alias("CustomerTarget"),
    )
    return {
        "PaymentInfo": collect_ordered(
            cards, ["cust_id"], ["_day", "PaymentInformationId"], ["PaymentInformationId", "Provider", "ExpiryDate"],
            "PaymentInfo", [F.col("_day")], ROWS,
        ),
        "DeviceInfo": collect_ordered(
            devices, ["cust_id"], ["_last", "DeviceId"], ["DeviceId", "AccessCount"], "DeviceInfo",
            [block_of("_last", 3_600_000_000)], ROWS,
        ),
        "FriendsAndFamily": collect_ordered(
            friends, ["cust_id"], ["FriendFamilyId"], ["FriendFamilyId", "CustomerTarget"], "FriendsAndFamily",
            [block_of("FriendFamilyId", ID_BLOCK)], ROWS,
        ),
    }


CUSTOMER_SQL = """
  pay0 as (select customer_id as cust_id, card_id, card_type, cast(issued + interval 36 month as date) as expiry,
                  row_number() over (partition by customer_id order by issued + interval 36 month desc, card_id) - 1 as i from oe_cards),
  pay as (select cust_id, i // 256 as chunk, list(struct_pack(PaymentInformationId := card_id, Provider := card_type,
            ExpiryDate := cast(expiry as varchar)) order by i) as v from pay0 group by all),
  dev0 as (select *, row_number() over (partition by cust_id order by last_access desc, device_id) - 1 as i from devices),
  dev as (select cust_id, i // 256 as chunk, list(struct_pack(DeviceId := device_id, AccessCount := access_count) order by i) as v from dev0 group by all),
  fri0 as (select *, row_number() over (partition by customer_id order by order_id) - 1 as i from oe_orders where order_mode = '5-LOW'),
  fri as (select customer_id as cust_id, i // 256 as chunk, list(struct_pack(FriendFamilyId := order_id, CustomerTarget := sales_rep_id) order by i) as v
          from fri0 group by all),
  spots as (select cust_id, 0 as chunk from customers union select cust_id, chunk from pay union select cust_id, chunk from dev
            union select cust_id, chunk from fri)"""


def _customer_query(extra: str):
    return f"""with {CUSTOMER_SQL}
select c.cust_id, to_json(struct_pack(CustomerID := c.cust_id, Name := cust_first_name || ' ' || cust_last_name, {extra}
   PaymentInfo := coalesce(pay.v, []), DeviceInfo := coalesce(dev.v, []), FriendsAndFamily := coalesce(fri.v, [])))::varchar as doc
from customers c join spots using (cust_id) left join pay using (cust_id, chunk) left join dev using (cust_id, chunk)
     left join fri using (cust_id, chunk)"""


@query("assemble_document", _customer_query(""))
def assemble_document(spark, sf):
    parent = shape(spark, sf, "customers")
    docs = documents.assemble(parent, "cust_id", customer_children(spark, sf))
    text = documents.to_document(
        {"CustomerID": "cust_id", "Name": F.concat_ws(" ", "cust_first_name", "cust_last_name"),
         **{n: n for n in ("PaymentInfo", "DeviceInfo", "FriendsAndFamily")}}
    )
    return docs.select("cust_id", text.alias("doc"))


@query(
    "movie_customer_document",
    _customer_query("Country := n.country_name, City := null,").replace(
        "from customers c", "from customers c join countries n on n.country_id = c.country_id"
    ),
)
def movie_customer_document(spark, sf):
    """The customer document of the movie store, with location fields."""
    parent = shape(spark, sf, "customers").join(shape(spark, sf, "countries"), "country_id")
    docs = documents.assemble(parent, "cust_id", customer_children(spark, sf))
    text = documents.to_document(
        {"CustomerID": "cust_id", "Name": F.concat_ws(" ", "cust_first_name", "cust_last_name"),
         "Country": "country_name", "City": F.lit(None).cast("string"),
         **{n: n for n in ("PaymentInfo", "DeviceInfo", "FriendsAndFamily")}}
    )
    return docs.select("cust_id", text.alias("doc"))


@query(
    "movie_stream_sale",
    """with dev as (select cust_id, arg_max(device_id, epoch_us(last_access)::hugeint * 1000000 - device_id) as device_id from devices group by 1),
            pay as (select customer_id as cust_id, arg_min(card_id, strftime(issued + interval 36 month, '%Y%m%d')::bigint::hugeint * -1000000000000 + card_id) as card_id
                    from oe_cards group by 1),
            picked as (select event_id, user_id as cust_id, ts, value, (event_id * 7919) % (select count(*) from documents) as movie_id
                       from events where event_type = 'purchase')
       select p.event_id as sales_transaction_id, p.cust_id, p.movie_id, coalesce(dev.device_id, -1) as device_id,
              pay.card_id as payment_information_id, cast(round(p.value * 100) as bigint) as payment_cents, m.year
       from picked p join movies m using (movie_id) left join dev using (cust_id) left join pay using (cust_id)""",
)
def movie_stream_sale(spark, sf):
    """A sale row per purchase event: its movie, the customer's last device and latest-expiring card."""
    from tallygrain.operators.windows import earliest_per, latest_per

    devices = shape(spark, sf, "devices").withColumn("_tie", -F.col("device_id"))
    device = latest_per(devices.select("cust_id", "device_id", "last_access", "_tie"), ["cust_id"], ["last_access", "_tie"])
    cards = shape(spark, sf, "oe_cards").select(
        F.col("customer_id").alias("cust_id"), F.col("card_id").alias("payment_information_id"),
        (-F.unix_date(F.add_months("issued", 36))).alias("_day"),
    )
    card = earliest_per(cards, ["cust_id"], ["_day", "payment_information_id"])
    movies = shape(spark, sf, "movies").select("movie_id", "year")
    # the viewer's pick: spread over the whole catalogue by event
    catalogue = movies.agg(F.count(F.lit(1))).scalar()
    picked = shape(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("sales_transaction_id"), F.col("user_id").alias("cust_id"),
        F.round(F.col("value") * 100).cast("long").alias("payment_cents"),
        ((F.col("event_id") * 7919) % catalogue).alias("movie_id"),
    )
    sold = joins.split_join(picked.join(movies, "movie_id"), device.select("cust_id", "device_id"), ["cust_id"], "left")
    paid = joins.split_join(sold, card.select("cust_id", "payment_information_id"), ["cust_id"], "left")
    return paid.withColumn("device_id", F.coalesce("device_id", F.lit(-1).cast("long")))


@query(
    "movie_add_review",
    r"""with w as (select conv_id, turn, text, regexp_extract(lower(text), '[\p{L}]+') as word from conversations),
            t as (select distinct word from w where word <> ''),
            words as (select distinct movie_id, year, unnest(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+')) as word from movies),
            hit as (select t.word, arg_max(movie_id, year * 1000000000000 - movie_id) as movie_id from t join words using (word) group by 1)
       select conv_id as cust_id, turn as review_id, movie_id, conv_id % 5 + 1 as star_rating, text as review
       from w join hit using (word)""",
)
def movie_add_review(spark, sf):
    """A review per message: the newest movie whose title holds the message's first word."""
    first_word = F.regexp_extract(F.lower("text"), r"[\p{L}]+", 0)
    reviews = shape(spark, sf, "conversations").select(
        F.col("conv_id").alias("cust_id"), F.col("turn").alias("review_id"), F.col("text").alias("review"),
        (F.col("conv_id") % 5 + 1).alias("star_rating"), first_word.alias("word"),
    ).filter("word <> ''")
    words = shape(spark, sf, "movies").select(
        "movie_id", "year", F.explode(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"))).alias("word")
    )
    # only searched words, then one movie per word before the reviews are joined
    searched = joins.semi(words, written(reviews.select("word").distinct(), "terms"), ["word"])
    newest = searched.groupBy("word").agg(
        F.max(F.struct("year", (-F.col("movie_id")).alias("_m"))).alias("_top")
    ).select("word", (-F.col("_top._m")).alias("movie_id"))
    return joins.split_join(reviews, newest, ["word"]).drop("word")


# --- documents without a schema -------------------------------------------------------------
def _mixed_collection(spark, sf) -> DataFrame:
    """Passengers as JSON lines: flights absent without an order, one object for one flight, else an array."""
    customers, orders = shape(spark, sf, "oe_customers"), shape(spark, sf, "oe_orders")
    flights = orders.select("customer_id", "order_id", F.unix_date("order_date").cast("long").alias("day"), "order_mode")
    # an ordinary passenger's flights; documents of any length are in chunks (document_scan)
    lists = collect_ordered(flights, ["customer_id"], ["day", "order_id"], ["day", "order_mode"], "flights", rows=ROWS)
    rows = customers.join(lists, "customer_id", "left")
    flight = lambda f: F.to_json(F.struct(f["day"].alias("FlightDate"), f["order_mode"].alias("Airport")))
    many = F.concat(F.lit("["), F.array_join(F.transform("flights", flight), ","), F.lit("]"))
    history = F.when(F.size("flights") == 1, flight(F.get("flights", F.lit(0)))).otherwise(many)
    head = F.to_json(
        F.struct(
            F.col("customer_id").alias("PassengerId"),
            F.struct(F.col("cust_first_name").alias("First"), F.col("cust_last_name").alias("Last")).alias("Name"),
            F.col("country_code").alias("Country"),
            F.coalesce("chunk", F.lit(0).cast("long")).alias("part"),
        )
    )
    tail = F.when(F.col("flights").isNull(), "}").otherwise(F.concat(F.lit(',"FlightHistory":'), history, F.lit("}")))
    path = work_folder(spark, "mixed")
    rows.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), tail).alias("value")).write.text(path)
    return schemaless.read_variants(spark, path)


@query(
    "schemaless_scan",
    """select c.customer_id as passenger_id, c.cust_first_name as first_name, count(o.order_id) as flights,
              arg_min(o.order_mode, strftime(o.order_date, '%Y%m%d') || lpad(o.order_id::varchar, 20, '0')) as first_airport
       from oe_customers c left join oe_orders o using (customer_id) group by all""",
)
def schemaless_scan(spark, sf):
    """Flights of every passenger from a collection whose fields are absent, single or arrays, no schema given."""
    docs = _mixed_collection(spark, sf)
    flights = schemaless.elements("doc", "$.FlightHistory")
    read = docs.select(
        schemaless.typed("doc", "$.PassengerId", "bigint").alias("passenger_id"),
        schemaless.typed("doc", "$.Name.First", "string").alias("first_name"),
        schemaless.typed("doc", "$.part", "bigint").alias("part"),
        F.size(flights).alias("n"),
        schemaless.typed(F.get(flights, F.lit(0)), "$.Airport", "string").alias("airport"),
    )
    return read.groupBy("passenger_id", "first_name").agg(
        F.sum("n").alias("flights"), F.min_by("airport", "part").alias("first_airport")
    )


@query(
    "schemaless_example",
    """select customer_id, cust_first_name, country_code from oe_customers
       where cust_first_name = 'MACHINERY' and country_code = 'NATION_3'""",
)
def schemaless_example(spark, sf):
    """Passengers that look like an example document, fields of its own type only."""
    docs = _mixed_collection(spark, sf).filter(schemaless.typed("doc", "$.part", "bigint") == 0)
    found = docs.filter(schemaless.matches("doc", {"Name": {"First": "MACHINERY"}, "Country": "NATION_3"}))
    return found.select(
        schemaless.typed("doc", "$.PassengerId", "bigint").alias("customer_id"),
        schemaless.typed("doc", "$.Name.First", "string").alias("cust_first_name"),
        schemaless.typed("doc", "$.Country", "string").alias("country_code"),
    )


@query(
    "schemaless_fields",
    """with k as (select c.customer_id, count(o.order_id) as n from oe_customers c left join oe_orders o using (customer_id) group by 1),
            parts as (select n, unnest(range(greatest(1, (n + 255) // 256))) as part from k),
            lens as (select case when n = 0 then 0 else least(256, n - part * 256) end as m from parts)
       select 'PassengerId' as field, 'BIGINT' as kind, count(*) as n from lens
       union all select 'Name', 'OBJECT', count(*) from lens
       union all select 'Country', 'STRING', count(*) from lens
       union all select 'part', 'BIGINT', count(*) from lens
       union all select 'FlightHistory', case when m = 1 then 'OBJECT' else 'ARRAY' end, count(*) from lens where m > 0 group by 2""",
)
def schemaless_fields(spark, sf):
    """Which fields the collection has, and of which types, found by aggregation."""
    return schemaless.fields_of(_mixed_collection(spark, sf))


@query(
    "schemaless_path",
    "select event_id, cast(props->>'$.k' as bigint) as k, cast(props->>'$.missing' as bigint) as missing from events",
)
def schemaless_path(spark, sf):
    """Typed values by path from a shredded collection: the field that all documents have is a column."""
    events = shape(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return schemaless.shred(events).select("event_id", "k", schemaless.typed("doc", "$.missing", "bigint").alias("missing"))
