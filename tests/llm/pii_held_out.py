"""Sentences written by hand, with their personal data marked as [[kind|text]]; no generator made them, and the field never saw them.

Some marked spans are matches of the base patterns too; those that are not are what the field alone can add.
"""

MARKED = """
You can reach Maria at [[phone|(415) 867-5309]] any weekday before noon.
My new cell is [[phone|212-555-0187]], please delete the old one.
Office: [[phone|030 9018 2400]], closed on Fridays.
Call us on [[phone|0800 123 4567]] or come by the shop.
Ring [[phone|020 7946 0991]] and ask for Dave.
Tel. [[phone|01 44 76 18 32]] du lundi au vendredi.
Fax [[phone|(312) 744-5000]], attention of the clerk.
Dial [[phone|+44 20 7946 0018]] if the line is busy.
Our agent answers at [[phone|646.555.2301]] all day long.
Telefon: [[phone|0221/9876543]] (Herr Schmidt)
Whoever finds the dog should phone [[phone|508-555-7712]]; there is a reward.
Emergency contact [[phone|(907) 555-0134]]
Send the manuscript to [[email|editor(at)riverpress.org]] by Monday.
Write to [[email|j.doe[at]uni-koeln.de]] for a copy of the data.
Questions? [[email|helpdesk{at}campus.edu]], we answer within a day.
Her address is [[email|anna [at] example [dot] com]] as far as I know.
Mail me: [[email|paul (at) smallshop (dot) net]]
Please email [[email|frank at widgets dot com]] about the invoice.
Contact [[email|sue.miller@school.example.edu]] to enrol.
Or drop a line to [[email|info(at)bakery(dot)fr]], she reads it daily.
The bug reports go to [[email|bugs[at]kernel[dot]org]] only.
The visa on file is [[card|4012.8888.8888.1881]] and expires in May.
He paid with card [[card|5555 5555 5555 4444]] on the spot.
Card number [[card|4111/1111/1111/1111]], name as on the passport.
Charge it to [[card|6011111111111117]] please.
Two cards were stolen: [[card|4111111111111111]] and [[card|5105-1051-0510-5100]].
The amex is lost but the mastercard [[card|5500_0000_0000_0004]] still works.
Blocked the host [[ip|203[.]0[.]113[.]42]] at the firewall.
The beacon called home to [[ip|198.51.100[.]7]] every hour.
Server [[ip|2001:db8:85a3:8d3:1319:8a2e:370:7348]] did not answer.
Add [[ip|fe80::1ff:fe23:4567:890a]] to the allow list.
Logins came from [[ip|192.0.2.44]] and from nowhere else.
Traffic to [[ip|10(.)20(.)30(.)40]] is dropped.
The meeting is on 2024-05-17 at 14:30 in room 2.041.
Order 4471-2093 shipped in 3 boxes of 12.5 kg each.
ISBN 978-0-306-40615-7 is out of print since 1999.
Version 10.15.7 fixes issue #48213, see pages 112-118.
The population grew from 12,345 to 13,901 (12.6%) in 2011.
Commit 9fceb02d0ae598e95dc970b74767f19372d61af8 broke the build.
Tracking number 9400 1000 0000 0000 0000 00 has no updates.
He finished in 2:03:59 and won 1,000,000 dollars.
Invoice 2023-0047 over 1.299,00 EUR is due on 30.06.2023.
We met at noon at the dot matrix museum in town.
The ratio is 16:9, the scale 1:250, the offset 0x7ffe.
Serial 00:1b:44:11:3a:b7 belongs to the printer.
Section 4.2.1 refers to table 3 and figure 12.
Follow @riverpress for news; the price is $19.99 or 18 pounds.
The lottery drew 04 17 23 31 42 and 08 last night.
Around 1500 people at 20 sites took part between 1998 and 2003.
Der Zug kommt um 17:45 an Gleis 12 an, Wagen 23, Platz 104.
La population est de 2 165 423 habitants en 2019.
""".strip().splitlines()


def parsed(line):
    """(text, [(start, kind, end)]) of a marked line."""
    import re

    text, spans, at = "", [], 0
    for m in re.finditer(r"\[\[(\w+)\|(.*?)\]\](?!\])", line):
        text += line[at : m.start()]
        spans.append((len(text), m[1], len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans
