"""The canonical schema that every dialect is mapped into."""

from __future__ import annotations

COMMENT = "struct<comment_id:string,author:string,author_id:string,text:string,likes:bigint,replies:bigint,ts:timestamp,position:int,verified:boolean>"
AUTHOR = "struct<id:string,username:string,name:string,url:string,followers:bigint,following:bigint,posts:bigint,verified:boolean>"
ENGAGEMENT = "struct<likes:bigint,comments:bigint,shares:bigint,views:bigint,total:bigint>"
MUSIC = "struct<title:string,author:string>"
POST = (
    f"platform string, post_id string, post_url string, source_type string, query string, source_window string, author {AUTHOR}, text string, lang_hint string, "
    f"ts timestamp, ts_raw string, scraped_at timestamp, hashtags array<string>, mentions array<string>, engagement {ENGAGEMENT}, music {MUSIC}, post_type string, "
    f"location string, location_source string, location_confidence double, comments array<{COMMENT}>"
)
