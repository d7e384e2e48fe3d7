"""Field mappings of provider feeds to the common posting, and link patterns of their boards.

A mapping gives the payload's kind, its schema (or item pattern), where its items are, and one
SQL expression per posting field over the exploded `item`.
"""

FEEDS = {
    "greenhouse": {
        "kind": "json",
        "schema": "jobs array<struct<id:bigint,title:string,absolute_url:string,updated_at:string,first_published:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>,requisition_id:string>>",
        "items": "parsed.jobs",
        "fields": {"native": "cast(item.id as string)", "title": "item.title", "url": "item.absolute_url", "posted_at": "coalesce(item.first_published, item.updated_at)",
                   "location": "item.location.name", "department": "get(item.departments, 0).name", "description": "item.content", "requisition": "item.requisition_id"},
    },
    "lever": {
        "kind": "json",
        "schema": "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,workplaceType:string,categories:struct<location:string,department:string,team:string,commitment:string>>>",
        "items": "parsed",
        "fields": {"native": "item.id", "title": "item.text", "url": "item.hostedUrl", "posted_at": "cast(item.createdAt as string)", "location": "item.categories.location",
                   "department": "coalesce(item.categories.department, item.categories.team)", "employment_type": "item.categories.commitment",
                   "description": "item.descriptionPlain", "remote": "case when item.workplaceType = 'remote' then true when item.workplaceType = 'on-site' then false end"},
    },
    "recruitee": {
        "kind": "json",
        "schema": "offers array<struct<id:bigint,title:string,careers_url:string,published_at:string,location:string,department:string,employment_type_code:string,description:string,remote:boolean>>",
        "items": "parsed.offers",
        "fields": {"native": "cast(item.id as string)", "title": "item.title", "url": "item.careers_url", "posted_at": "item.published_at", "location": "item.location",
                   "department": "item.department", "employment_type": "item.employment_type_code", "description": "item.description", "remote": "item.remote"},
    },
    "ashby": {
        "kind": "json",
        "schema": "jobs array<struct<id:string,title:string,location:string,department:string,jobUrl:string,publishedAt:string,employmentType:string,isListed:boolean,isRemote:boolean,workplaceType:string,descriptionPlain:string,descriptionHtml:string>>",
        "items": "filter(parsed.jobs, j -> coalesce(j.isListed, true))",
        "fields": {"native": "item.id", "title": "trim(item.title)", "url": "item.jobUrl", "posted_at": "item.publishedAt", "location": "item.location", "department": "item.department",
                   "employment_type": "item.employmentType", "description": "coalesce(item.descriptionPlain, item.descriptionHtml)",
                   "remote": "case when lower(item.workplaceType) = 'hybrid' then null else item.isRemote end"},
    },
    "workable": {
        "kind": "json",
        "schema": "name string, jobs array<struct<shortcode:string,title:string,city:string,state:string,country:string,telecommuting:boolean,department:string,url:string,application_url:string,published_on:string,created_at:string,description:string,experience:string,employment_type:string>>",
        "items": "parsed.jobs",
        "fields": {"native": "item.shortcode", "title": "trim(item.title)", "url": "coalesce(item.url, item.application_url)", "posted_at": "coalesce(item.published_on, item.created_at)",
                   "location": "nullif(concat_ws(', ', nullif(item.city, ''), nullif(item.state, ''), nullif(item.country, '')), '')", "department": "item.department",
                   "employment_type": "item.employment_type", "experience": "item.experience", "description": "item.description", "remote": "item.telecommuting"},
    },
    "smartrecruiters": {
        "kind": "json",
        "schema": "content array<struct<id:string,name:string,releasedDate:string,company:struct<name:string>,location:struct<fullLocation:string,city:string,region:string,country:string,remote:boolean>,department:struct<label:string>,typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>>",
        "items": "parsed.content",
        "fields": {"native": "item.id", "title": "trim(item.name)", "posted_at": "item.releasedDate", "department": "item.department.label", "employment_type": "item.typeOfEmployment.label",
                   "location": "coalesce(array_join(filter(transform(split(item.location.fullLocation, ','), x -> trim(x)), x -> x <> ''), ', '), nullif(concat_ws(', ', item.location.city, item.location.region, item.location.country), ''))",
                   "experience": "item.experienceLevel.label", "remote": "item.location.remote"},
    },
    "breezy": {
        "kind": "json",
        "schema": "array<struct<id:string,friendly_id:string,name:string,url:string,published_date:string,department:string,description:string,type:struct<name:string>,location:struct<name:string,is_remote:boolean>,salary:string>>",
        "items": "parsed",
        "fields": {"native": "item.id", "title": "trim(item.name)", "url": "item.url", "posted_at": "item.published_date", "location": "item.location.name", "department": "nullif(item.department, '')",
                   "employment_type": "item.type.name", "description": "item.description", "salary": "item.salary", "remote": "item.location.is_remote"},
    },
    "teamtailor": {
        "kind": "json",
        "schema": "title string, items array<struct<id:string,title:string,url:string,date_published:string,content_html:string,_jobposting:struct<employmentType:string,datePosted:string,hiringOrganization:struct<name:string>,jobLocation:array<struct<address:struct<addressLocality:string,addressCountry:string>>>>>>",
        "items": "parsed.items",
        "fields": {"native": "item.id", "title": "trim(item.title)", "url": "item.url", "posted_at": "coalesce(item.date_published, item._jobposting.datePosted)", "description": "item.content_html",
                   "employment_type": "item._jobposting.employmentType",
                   "location": "nullif(array_join(array_distinct(transform(item._jobposting.jobLocation, l -> concat_ws(', ', l.address.addressLocality, l.address.addressCountry))), '; '), '')"},
    },
    "workday": {
        "kind": "json",
        "schema": "jobPostings array<struct<title:string,externalPath:string,locationsText:string,timeType:string,remoteType:string,jobFamilyGroup:string,bulletFields:array<string>>>",
        "items": "filter(parsed.jobPostings, j -> coalesce(trim(j.title), '') <> '' or coalesce(j.externalPath, '') <> '')",
        "fields": {"native": "coalesce(nullif(regexp_extract(item.externalPath, '_([^_/]+)$', 1), ''), get(item.bulletFields, 0))", "title": "coalesce(nullif(trim(item.title), ''), 'Untitled')", "url": "item.externalPath",
                   "location": "item.locationsText", "department": "nullif(trim(item.jobFamilyGroup), '')", "employment_type": "item.timeType",
                   "requisition": "coalesce(nullif(regexp_extract(item.externalPath, '_([^_/]+)$', 1), ''), get(item.bulletFields, 0))",
                   "remote": "case when lower(item.remoteType) like '%remote%' and lower(item.remoteType) not like '%hybrid%' then true when item.remoteType is not null then false end"},
    },
    "bamboohr": {
        "kind": "json",
        "schema": "result array<struct<id:string,jobOpeningName:string,departmentLabel:string,employmentStatusLabel:string,datePosted:string,description:string,minimumExperience:string,locationType:string,location:struct<city:string,state:string>>>",
        "items": "parsed.result",
        "fields": {"native": "item.id", "title": "trim(item.jobOpeningName)", "location": "nullif(concat_ws(', ', nullif(item.location.city, ''), nullif(item.location.state, '')), '')", "department": "nullif(trim(item.departmentLabel), '')",
                   "employment_type": "nullif(trim(item.employmentStatusLabel), '')", "posted_at": "item.datePosted", "description": "item.description", "experience": "nullif(trim(item.minimumExperience), '')",
                   "remote": "case item.locationType when '1' then true when '0' then false end"},
    },
    "pinpoint": {
        "kind": "json",
        "schema": "data array<struct<id:string,title:string,url:string,description:string,employment_type_text:string,workplace_type:string,compensation:string,location:struct<name:string,city:string,province:string>,job:struct<department:struct<name:string>>>>",
        "items": "parsed.data",
        "fields": {"native": "item.id", "title": "trim(item.title)", "url": "item.url", "location": "coalesce(nullif(concat_ws(', ', nullif(item.location.city, ''), nullif(item.location.province, '')), ''), item.location.name)",
                   "department": "item.job.department.name", "employment_type": "nullif(item.employment_type_text, '')", "description": "item.description", "salary": "nullif(item.compensation, '')",
                   "remote": "case item.workplace_type when 'remote' then true when 'onsite' then false end"},
    },
    "oracle": {
        "kind": "json",
        "schema": "items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,PrimaryLocationCountry:string,Department:string,JobFunction:string,JobType:string,JobSchedule:string,ShortDescriptionStr:string,WorkplaceTypeCode:string>>>>",
        "items": "flatten(transform(parsed.items, i -> i.requisitionList))",
        "fields": {"native": "item.Id", "title": "trim(item.Title)", "location": "coalesce(item.PrimaryLocation, item.PrimaryLocationCountry)", "department": "coalesce(item.Department, item.JobFunction)", "posted_at": "item.PostedDate",
                   "employment_type": "coalesce(item.JobType, item.JobSchedule)", "description": "item.ShortDescriptionStr", "requisition": "item.Id",
                   "remote": "case item.WorkplaceTypeCode when 'ORA_REMOTE' then true when 'ORA_ON_SITE' then false end"},
    },
    "eightfold": {
        "kind": "json",
        "schema": "positions array<struct<id:bigint,name:string,location:string,department:string,t_create:bigint,ats_job_id:string,job_description:string,work_location_option:string,canonicalPositionUrl:string>>",
        "items": "parsed.positions",
        "fields": {"native": "cast(item.id as string)", "title": "nullif(trim(item.name), '')", "url": "item.canonicalPositionUrl", "location": "item.location", "department": "item.department", "description": "item.job_description",
                   "requisition": "item.ats_job_id", "posted_at": "date_format(timestamp_seconds(item.t_create), 'yyyy-MM-dd')",
                   "remote": "case when lower(item.work_location_option) like 'remote%' then true when lower(item.work_location_option) = 'onsite' then false end"},
    },
    "phenom": {
        "kind": "json",
        "schema": "refineSearch struct<data:struct<jobs:array<struct<jobId:string,reqId:string,title:string,cityStateCountry:string,location:string,category:string,type:string,postedDate:string,dateCreated:string,applyUrl:string>>>>",
        "items": "filter(parsed.refineSearch.data.jobs, j -> coalesce(j.jobId, '') <> '')",
        "fields": {"native": "item.jobId", "title": "trim(item.title)", "url": "item.applyUrl", "location": "coalesce(item.cityStateCountry, item.location)", "department": "item.category", "employment_type": "item.type",
                   "posted_at": "coalesce(item.postedDate, item.dateCreated)", "requisition": "item.reqId"},
    },
    "personio": {
        "kind": "xml",
        "schema": "position array<struct<id:string,name:string,office:string,department:string,employmentType:string,seniority:string,createdAt:string>>",
        "items": "parsed.position",
        "fields": {"native": "item.id", "title": "item.name", "location": "item.office", "department": "item.department", "employment_type": "item.employmentType",
                   "experience": "item.seniority", "posted_at": "item.createdAt"},
    },
    "rss": {
        "kind": "xml",
        "schema": "channel struct<item:array<struct<guid:string,title:string,link:string,pubDate:string,description:string,location:string>>>",
        "items": "parsed.channel.item",
        "fields": {"native": "item.guid", "title": "item.title", "url": "item.link", "posted_at": "item.pubDate", "description": "item.description", "location": "item.location"},
    },
    "listing_page": {
        "kind": "html",
        "item": r"(?is)<li class=\"job\".*?</li>",
        "fields": {"native": r"(?i)data-id=\"([^\"]+)\"", "title": r"(?is)<h3>(.*?)</h3>", "url": r"(?i)href=\"([^\"]+)\"", "location": r"(?is)<span class=\"place\">(.*?)</span>"},
    },
}

# (provider, pattern with one group, lower-case the token)
BOARD_LINKS = (
    ("greenhouse", r"(?i)boards\.greenhouse\.io/([A-Za-z0-9_-]+)", True),
    ("lever", r"(?i)jobs\.lever\.co/([A-Za-z0-9_.-]+)", True),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)", False),
    ("recruitee", r"(?i)https?://([a-z0-9-]+)\.recruitee\.com", True),
    ("personio", r"(?i)https?://([a-z0-9-]+)\.jobs\.personio\.(?:de|com)", True),
    ("teamtailor", r"(?i)https?://([a-z0-9-]+)\.teamtailor\.com", True),
    ("breezy", r"(?i)https?://([a-z0-9-]+)\.breezy\.hr", True),
    ("smartrecruiters", r"(?i)(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)", False),
    ("workable", r"(?i)apply\.workable\.com/([A-Za-z0-9_-]+)", True),
)
BLOCKED_TOKENS = ("www", "api", "embed", "static", "assets", "cdn", "help", "support", "about")

# (provider, registered domain, pattern with the tenant in group 1)
TENANT_SPECS = (
    ("recruitee", "recruitee.com", r"^https?://([a-z0-9-]+)\.recruitee\.com"),
    ("personio", "personio.de", r"^https?://([a-z0-9-]+)\.jobs\.personio\.de"),
    ("teamtailor", "teamtailor.com", r"^https?://([a-z0-9-]+)\.teamtailor\.com"),
    ("breezy", "breezy.hr", r"^https?://([a-z0-9-]+)\.breezy\.hr"),
    ("bamboohr", "bamboohr.com", r"^https?://([a-z0-9-]+)\.bamboohr\.com"),
)
