"""Explicit schemas of all inputs; nothing is inferred."""

from __future__ import annotations

ARTICLE = "id string, title string, url string, text string"
STORED_ARTICLE = "id bigint, title string, content string, url string, created_at timestamp, wikipedia_page_id int, has_temporal_info boolean, earliest_date date, latest_date date"
SECTION = "id bigint, article_id bigint, section_title string, section_text string, section_order int"
REDIRECT = "source_title string, target_title string"
INDEX_DOCUMENT = "article_id string, section_id string, title string, section_title string, text string, url string, embedding array<float>"
PAGE = "title string, id bigint, ns int, revision struct<text:struct<_VALUE:string>>"
DATED_ENTITY = "Entity string, Wikipedia_URL string, Earliest_Date string, Latest_Date string"
DATED_ENTITY_WITH_ID = "Entity string, Entity_ID string, Wikipedia_URL string, Earliest_Date string, Latest_Date string"
NORMALIZED_ENTITY = "Entity string, Wikipedia_Title string, Wikipedia_ID string, Wikipedia_URL string, Earliest_Date string, Latest_Date string, Original_URL string"
_REFERENCE = "struct<title:string,article_path:string,href:string,source:string,relevance_score:double,article_id:bigint>"
_RELATED = "struct<title:string,article_id:bigint,relevance_score:double,search_score:double,title_similarity:double>"
_TOPIC = f"struct<year:int,date:string,month:int,day:int,date_text:string,topic:string,direct_references:array<{_REFERENCE}>,related_articles:array<{_RELATED}>>"
YEAR_TOPICS = f"year int, extracted_date string, source string, total_topics int, topics array<{_TOPIC}>"
BOOK = "id bigint, title string, author string, text string, length bigint, pub_year int, method string, author_death_year int, is_known_pre1969_author boolean, subject string"
CHUNK = "work_id bigint, work_title string, chunk_id int, text string, length int"
OVERLAP_CHUNK = "work_id bigint, work_title string, chunk_id int, text string, start_word int, end_word int"
_QA_METADATA = "struct<source_article_id:bigint,source_title:string,temporal_class:string,earliest_date:string,latest_date:string,dataset_type:string,original_answer:string,source_type:string,topic_year:int,topic_date:string,topic_text:string>"
QA_PAIR = f"instruction string, output string, metadata {_QA_METADATA}"
CHAT_EXAMPLE = "messages array<struct<role:string,content:string>>, metadata struct<source_id:bigint,source_title:string,chunk_id:string,prompt_variant:string>"
LEDGER = "used_article_ids array<bigint>, total_count int, last_updated string, run_history array<struct<timestamp:string,model:string,articles_added:int>>"
