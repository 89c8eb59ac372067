"""Explicit schemas: reads never infer, and fields that a file lacks come back null."""

from __future__ import annotations

#: DDL of each raw record; ``extras`` and other free-form objects stay JSON text.
LINK = "array<struct<url:string,media_type:string>>"
VERSION = f"array<struct<note:string,links:{LINK},date:string,classification:string>>"
SOURCE = "array<struct<url:string,note:string>>"
ACTION = (
    "struct<description:string,date:string,occurred_at:string,organization_id:string,jurisdiction_id:string,session_id:string,"
    "entity_type:string,classification:array<string>,classifications:array<string>,"
    "related_entities:array<struct<entity_type:string,entity_id:string,name:string,note:string>>,"
    "_processing:struct<log_file_created:string>>"
)
BILL = (
    "legislative_session string, identifier string, title string, from_organization string, classification array<string>, "
    "subject array<string>, abstracts array<struct<abstract:string,note:string>>, "
    "other_titles array<struct<title:string,note:string>>, other_identifiers array<string>, "
    f"actions array<{ACTION}>, "
    "sponsorships array<struct<name:string,classification:string,entity_type:string,primary:boolean>>, "
    f"versions {VERSION}, documents {VERSION}, sources {SOURCE}, "
    "jurisdiction struct<id:string,name:string,classification:string,division_id:string>, "
    "_processing struct<logs_latest_update:string,text_extraction_latest_update:string,"
    "text_extraction_unavailable:struct<reason:string,checked_at:string>>, scraped_at string"
)
LOG = (
    f"action {ACTION}, bill_id string, motion_text string, result string, start_date string, organization string, "
    "bill_identifier string, votes array<struct<option:string,voter_name:string,voter_id:string,note:string>>, "
    "counts array<struct<option:string,value:bigint>>"
)
VOTE_EVENT = (
    "identifier string, motion_text string, motion_classification array<string>, start_date string, result string, "
    "organization string, legislative_session string, bill string, bill_action string, bill_identifier string, "
    f"votes array<struct<option:string,voter_name:string,voter_id:string,note:string>>, "
    f"counts array<struct<option:string,value:bigint>>, sources {SOURCE}, _id string"
)
EVENT = (
    "name string, description string, start_date string, end_date string, status string, classification string, "
    "agenda array<struct<description:string,order:int,subjects:array<string>,"
    "related_entities:array<struct<entity_type:string,entity_id:string,name:string,note:string>>>>, _id string"
)
JURISDICTION = (
    "_id string, id string, name string, url string, division_id string, classification string, "
    "legislative_sessions array<struct<identifier:string,name:string,start_date:string,end_date:string,"
    "classification:string,active:boolean>>"
)
POLL = (
    "fleet string, config string, state string, org string, repo string, paused boolean, polled_at string, "
    "workflows array<struct<workflow:string,latest_conclusion:string,hours_since_success:double>>, "
    "data_commit_age_hours double, errors array<string>"
)
RUN = "id bigint, status string, conclusion string, created_at string, html_url string"
