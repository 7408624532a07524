"""Small payloads in the formats of the adapters, for queries and tests. All names are invented."""

from __future__ import annotations

WIKI = """<mediawiki>
<page><title>Harbour ledger</title><ns>0</ns><id>10</id>
<revision><id>103</id><parentid>102</parentid><timestamp>2013-03-03T10:00:00Z</timestamp><contributor><username>Ada</username><id>7</id></contributor><comment>restore</comment><origin>103</origin><model>wikitext</model><format>text/x-wiki</format><text>The ledger lists boats. It is kept in the '''old''' tower.</text></revision>
<revision><id>101</id><timestamp>2013-03-01T10:00:00Z</timestamp><contributor><ip>192.0.2.9</ip></contributor><origin>101</origin><model>wikitext</model><format>text/x-wiki</format><text>The ledger lists boats.</text></revision>
<revision><id>102</id><parentid>101</parentid><timestamp>2013-03-02T10:00:00Z</timestamp><contributor><username>Bo</username><id>8</id></contributor><minor/><origin>102</origin><model>wikitext</model><format>text/x-wiki</format><text>The ledger lists boats. {{stub|x}} [[Category:Harbours]]</text></revision>
</page>
<page><title>Quiet mill</title><ns>0</ns><id>20</id>
<revision><id>201</id><timestamp>2018-05-01T08:00:00Z</timestamp><contributor><username>Cy</username><id>9</id></contributor><origin>201</origin><model>wikitext</model><format>text/x-wiki</format><text>A mill stands by the [[river|quiet river]].</text></revision>
<revision><id>202</id><parentid>201</parentid><timestamp>2018-05-01T08:00:00Z</timestamp><contributor><username>Cy</username><id>9</id></contributor><origin>202</origin><model>wikitext</model><format>text/x-wiki</format><text>A mill stands by the [[river|quiet river]]. Its wheel turns at night.</text></revision>
<revision><id>203</id><parentid>202</parentid><timestamp>2018-05-03T08:00:00Z</timestamp><contributor><username>Di</username><id>11</id></contributor><origin>203</origin><model>wikitext</model><format>text/x-wiki</format><text>A mill stands by the [[river|quiet river]].</text></revision>
</page>
</mediawiki>"""

POSTS = """<posts>
<row Id="1" PostTypeId="1" CreationDate="2013-01-01T09:00:00.000" Score="3" Body="How do I mend a &lt;code&gt;net&lt;/code&gt; quickly?" OwnerUserId="5" Title="Mending a net" Tags="&lt;nets&gt;" />
<row Id="2" PostTypeId="2" ParentId="1" CreationDate="2013-01-02T09:00:00.000" Score="1" Body="Tie a new knot." OwnerUserId="6" />
<row Id="3" PostTypeId="1" CreationDate="2018-06-01T09:00:00.000" Score="0" Body="Which oar is longer?" OwnerDisplayName="guest" Title="Oars" Tags="&lt;oars&gt;" />
<row Id="4" PostTypeId="2" ParentId="3" CreationDate="2018-05-30T09:00:00.000" Score="0" Body="The left one." OwnerUserId="7" />
</posts>"""

HISTORY = """<posthistory>
<row Id="11" PostHistoryTypeId="1" PostId="1" RevisionGUID="g1" CreationDate="2013-01-01T09:00:00.000" UserId="5" Text="Mending a net" />
<row Id="12" PostHistoryTypeId="2" PostId="1" RevisionGUID="g1" CreationDate="2013-01-01T09:00:00.000" UserId="5" Text="How do I mend a net?" />
<row Id="13" PostHistoryTypeId="3" PostId="1" RevisionGUID="g1" CreationDate="2013-01-01T09:00:00.000" UserId="5" Text="&lt;nets&gt;" />
<row Id="14" PostHistoryTypeId="5" PostId="1" RevisionGUID="g2" CreationDate="2013-01-05T09:00:00.000" UserId="6" Text="How do I mend a &lt;code&gt;net&lt;/code&gt; quickly?" />
<row Id="15" PostHistoryTypeId="2" PostId="2" RevisionGUID="g3" CreationDate="2013-01-02T09:00:00.000" UserId="6" Text="Tie a new knot." />
<row Id="16" PostHistoryTypeId="1" PostId="3" RevisionGUID="g4" CreationDate="2018-06-01T09:00:00.000" UserDisplayName="guest" Text="Oars" />
<row Id="17" PostHistoryTypeId="2" PostId="3" RevisionGUID="g5" CreationDate="2018-06-01T09:00:00.000" UserDisplayName="guest" Text="Which oar is longer?" />
<row Id="18" PostHistoryTypeId="2" PostId="4" RevisionGUID="g6" CreationDate="2018-05-30T09:00:00.000" UserId="7" Text="The left one." />
</posthistory>"""

OAI_RAW = """<OAI-PMH><responseDate>2026-01-01T00:00:00Z</responseDate><ListRecords>
<record><header><identifier>oai:example.org:2204.00011</identifier><datestamp>2013-02-01</datestamp></header><metadata><raw><id>2204.00011</id>
<version version="v1"><date>Tue, 01 Jan 2013 10:00:00 GMT</date></version><version version="v2"><date>Fri, 01 Feb 2013 10:00:00 GMT</date></version>
<title>On slow tides</title><categories>physics.optics astro-ph.EP</categories><license>http://creativecommons.org/licenses/by/4.0/</license></raw></metadata></record>
<record><header><identifier>oai:example.org:2204.00012</identifier><datestamp>2013-02-02</datestamp></header><metadata><raw><id>2204.00012</id>
<version version="v1"><date>Fri, 01 Feb 2013 10:00:00 GMT</date></version><version version="v2"><date>Tue, 01 Jan 2013 10:00:00 GMT</date></version>
<title>On fast tides</title><categories>cs.CL</categories></raw></metadata></record>
<record><header status="deleted"><identifier>oai:example.org:2204.00013</identifier><datestamp>2013-02-03</datestamp></header></record>
<resumptionToken>page-2</resumptionToken></ListRecords></OAI-PMH>"""

OAI_DC = """<OAI-PMH><ListRecords>
<record><header><identifier>oai:example.org:77</identifier><datestamp>2019-05-01</datestamp><setSpec>open</setSpec></header><metadata><dc>
<title>Notes on reeds</title><creator>A. Heron</creator><creator>B. Teal</creator><subject>botany</subject><date>2019-04</date><date>2019-05-01</date><identifier>REC77</identifier><rights>CC BY 4.0</rights></dc></metadata></record>
<record><header><identifier>oai:example.org:78</identifier><datestamp>2019-05-02</datestamp><setSpec>open</setSpec></header><metadata><dc>
<title>Notes on rushes</title><creator>C. Coot</creator><date>2018</date><identifier>REC78</identifier><rights>CC BY 4.0</rights><rights>all rights reserved</rights></dc></metadata></record>
</ListRecords></OAI-PMH>"""

ATOM = """<feed><totalResults>2</totalResults><startIndex>0</startIndex><itemsPerPage>2</itemsPerPage>
<entry><id>http://arxiv.org/abs/2204.00011v2</id><published>2013-01-01T10:00:00Z</published><updated>2013-02-01T10:00:00Z</updated><title>On slow tides</title><summary>Tides.</summary><author><name>A. Heron</name></author><author><name>B. Teal</name></author><category term="physics.optics"/><category term="astro-ph.EP"/></entry>
<entry><id>http://arxiv.org/abs/1807.01234</id><published>2018-07-01T10:00:00Z</published><updated>2018-07-01T10:00:00Z</updated><title>On eddies</title><summary>Eddies.</summary><author><name>C. Coot</name></author><category term="cs.CL"/></entry></feed>"""

ARCHIVE = """{"metadata": {"identifier": "exchange-dump", "licenseurl": "https://creativecommons.org/licenses/by-sa/4.0/"}, "files": [
{"name": "boats.example.com.7z", "size": "1200", "md5": "0123456789abcdef0123456789abcdef", "sha1": "0123456789abcdef0123456789abcdef01234567", "mtime": "1500000000", "format": "7z"},
{"name": "__meta.7z", "size": "10", "md5": "0123456789abcdef0123456789abcdef", "mtime": "1500000001", "format": "7z"},
{"name": "mills.example.com.7z", "size": "800", "md5": "fedcba9876543210fedcba9876543210", "mtime": "1600000000", "format": "7z"},
{"name": "readme.txt", "size": "5", "mtime": "1600000002", "format": "text"}]}"""

DUMP = """{"jobs": {"articlesdump": {"status": "done", "files": {"wiki-pages-articles1.xml.bz2": {"size": 500, "md5": "0123456789abcdef0123456789abcdef", "sha1": "0123456789abcdef0123456789abcdef01234567", "url": "/d/1"},
"wiki-pages-articles2.xml.bz2": {"size": 700, "md5": "fedcba9876543210fedcba9876543210", "url": "/d/2"}, "wiki-index.txt.bz2": {"size": 3, "url": "/d/3"}}}, "statsdump": {"status": "waiting", "files": {"wiki-pages-articles9.xml.bz2": {"size": 9}}}}}"""
