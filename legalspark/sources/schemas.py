"""Schemas of the inputs. Reads are permissive: missing keys are null."""

_CLAUSE = "struct<id:string,text:string,clauses:array<struct<id:string,text:string>>,sub_clauses:array<struct<id:string,text:string>>>"
_ARTICLE = f"struct<article_number:string,section_number:string,title:string,content:string,page_number:int,part:string,chapter:string,clauses:array<{_CLAUSE}>,subsections:array<{_CLAUSE}>>"

STATUTE = f"document struct<title:string,year:int,source_file:string,articles:array<{_ARTICLE}>,sections:array<{_ARTICLE}>>, _corrupt_record string"

#: Every field of the courts' listings; each court fills some of them.
CASE = (
    "sr_no:string,s_no:string,record_id:string,case_title:string,parties:string,writ_petition:string,case_number:string,case_no:string,citation:string,lhc_citation:string,phc_neutral_citation:string,"
    "other_citation:string,date:string,date_of_judgment:string,order_date:string,decision_date:string,year:string,hon_judge:string,judges:string,judge:string,bench:string,before:string,author:string,"
    "matter:string,location:string,remarks:string,description:string,excerpt:string,category:string,discussed_laws:string,pdf_link:string,download_link:string,judgment_link:string,court:string,scraped_at:string,"
    "scanned_at:string,cyber_keywords_matched:array<string>,cyber_law_reason:string,cyber_law_match:struct<filter_profile:string,triggers:array<struct<kind:string,matched:string>>>,pdf_data:string,winner:string"
)
#: Wrapper keys in the order in which they are looked for.
WRAPPERS = ("judgments", "cases", "data", "results")

CHARS = "doc_id string, page int, top double, x0 double, text string, size double, fontname string"
RULES = "doc_id string, page int, y0 double, y1 double, width double, height double, kind string"
PAGES = "doc_id string, page int, width double, height double"
EXAMPLES = "instruction string, input string, output string, _metadata struct<source_case_no:string,source_court:string,variation_index:int>"
BENCHMARK = "query string, answer string, gold_passages array<string>, scenario_context string"
TURNS = "session_id string, question string, answer string, ts timestamp, duration double"
