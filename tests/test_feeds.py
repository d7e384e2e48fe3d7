"""One small payload per provider kind, normalised by its mapping."""

import pytest

from hirelake.sources.web import normalize_feed

PAYLOADS = {
    "greenhouse": ('{"jobs":[{"id":7,"title":"Dev","absolute_url":"https://x/7","updated_at":"2026-01-02","location":{"name":"Berlin"},"departments":[]}]}', ("greenhouse:s:7", "Dev", "Berlin", None)),
    "lever": ('[{"id":"a","text":"Dev","categories":{"location":"Paris","commitment":"Full-time"},"workplaceType":"remote"}]', ("lever:s:a", "Dev", "Paris", True)),
    "ashby": ('{"jobs":[{"id":"a","title":" Dev ","location":"Rome","isRemote":true,"workplaceType":"Hybrid"},{"id":"b","title":"Hidden","isListed":false}]}', ("ashby:s:a", "Dev", "Rome", None)),
    "workable": ('{"name":"Co","jobs":[{"shortcode":"X1","title":"Dev","city":"Athens","state":"","country":"Greece","telecommuting":false}]}', ("workable:s:X1", "Dev", "Athens, Greece", False)),
    "smartrecruiters": ('{"content":[{"id":"9","name":"Dev","location":{"fullLocation":"Pune, , India","remote":false}}]}', ("smartrecruiters:s:9", "Dev", "Pune, India", False)),
    "breezy": ('[{"id":"q","name":"Dev","location":{"name":"Oslo","is_remote":false}}]', ("breezy:s:q", "Dev", "Oslo", False)),
    "teamtailor": ('{"title":"Co","items":[{"id":"5","title":"Dev","_jobposting":{"jobLocation":[{"address":{"addressLocality":"Kiruna","addressCountry":"SE"}}]}}]}', ("teamtailor:s:5", "Dev", "Kiruna, SE", None)),
    "recruitee": ('{"offers":[{"id":3,"title":"Dev","location":"Delft","remote":true}]}', ("recruitee:s:3", "Dev", "Delft", True)),
    "personio": ("<workzag-jobs><position><id>4</id><name>Dev</name><office>Munich</office></position></workzag-jobs>", ("personio:s:4", "Dev", "Munich", None)),
    "workday": ('{"jobPostings":[{"title":" Dev ","externalPath":"/job/Berlin/Dev_R-12","locationsText":"Berlin","remoteType":"Fully Remote","bulletFields":["R-12"]},{"bulletFields":["R-13"]}]}', ("workday:s:R-12", "Dev", "Berlin", True)),
    "bamboohr": ('{"result":[{"id":"31","jobOpeningName":"Dev","departmentLabel":"IT","location":{"city":"Provo","state":"Utah"},"locationType":"0"}]}', ("bamboohr:s:31", "Dev", "Provo, Utah", False)),
    "pinpoint": ('{"data":[{"id":"77","title":"Dev","workplace_type":"remote","location":{"name":"HQ","city":"Leeds","province":""},"job":{"department":{"name":"Tech"}}}]}', ("pinpoint:s:77", "Dev", "Leeds", True)),
    "oracle": ('{"items":[{"requisitionList":[{"Id":"300","Title":"Dev","PrimaryLocation":"Lyon, France","WorkplaceTypeCode":"ORA_ON_SITE"}]}]}', ("oracle:s:300", "Dev", "Lyon, France", False)),
    "eightfold": ('{"positions":[{"id":446,"name":"Dev","location":"Austin, TX","t_create":1767225600,"work_location_option":"remote_local"}]}', ("eightfold:s:446", "Dev", "Austin, TX", True)),
    "phenom": ('{"refineSearch":{"data":{"jobs":[{"jobId":"P9","title":"Dev","cityStateCountry":"Cork, Ireland","category":"Tech"},{"title":"no id"}]}}}', ("phenom:s:P9", "Dev", "Cork, Ireland", None)),
    "rss": ("<rss><channel><item><guid>8</guid><title>Dev</title><location>Bonn</location></item></channel></rss>", ("rss:s:8", "Dev", "Bonn", None)),
    "listing_page": ('<ul><li class="job" data-id="2"><h3>Dev</h3><span class="place">Graz</span></li></ul>', ("listing_page:s:2", "Dev", "Graz", None)),
}


@pytest.mark.parametrize("provider", sorted(PAYLOADS))
def test_provider(spark, provider):
    payload, want = PAYLOADS[provider]
    raw = spark.createDataFrame([("s", "Co", payload)], "slug string, company string, payload string")
    got = [(r["id"], r["title"], r["location"], r["remote"]) for r in normalize_feed(raw, provider).collect()]
    assert got == [want]


def test_unreadable_payload_gives_no_rows(spark):
    raw = spark.createDataFrame([("s", "Co", "not json")], "slug string, company string, payload string")
    assert normalize_feed(raw, "greenhouse").count() == 0
