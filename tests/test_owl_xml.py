"""OWL/XML: a file by hand, round trips."""

from weftgraph.sources import owl_xml

HAND = """<?xml version="1.0"?>
<Ontology xmlns="http://www.w3.org/2002/07/owl#">
  <!-- <Declaration><Class IRI="#Hidden"/></Declaration> -->
  <Declaration><Class IRI="#Pump"/></Declaration>
  <Declaration>
    <DataProperty abbreviatedIRI=":flow"/>
  </Declaration>
  <Declaration><NamedIndividual IRI="#p1"/></Declaration>
  <SubClassOf><Class IRI="#Pump"/><Class IRI="#Device"/></SubClassOf>
  <SubClassOf><Class IRI="#Pump"/><ObjectSomeValuesFrom><ObjectProperty IRI="#feeds"/><Class IRI="#Pipe"/></ObjectSomeValuesFrom></SubClassOf>
  <ObjectPropertyDomain><ObjectProperty IRI="#feeds"/><Class IRI="#Pump"/></ObjectPropertyDomain>
  <DataPropertyRange><DataProperty abbreviatedIRI=":flow"/><Datatype abbreviatedIRI="xsd:double"/></DataPropertyRange>
  <AnnotationAssertion><AnnotationProperty abbreviatedIRI="rdfs:comment"/><IRI>#Pump</IRI><Literal>moves &lt;water&gt;</Literal></AnnotationAssertion>
</Ontology>
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_file_by_hand(spark, tmp_path):
    (tmp_path / "o.owx").write_text(HAND)
    assert rows(owl_xml.read(spark, str(tmp_path))) == [
        ("#Pump", "a", "owl:Class"), ("#Pump", "rdfs:comment", '"moves <water>"'), ("#Pump", "rdfs:subClassOf", "#Device"), ("#feeds", "rdfs:domain", "#Pump"), (":flow", "a", "owl:DatatypeProperty"), (":flow", "rdfs:range", "xsd:double"),
    ]


def test_what_is_written_is_read(spark, tmp_path):
    triples = [(":A", "a", "owl:Class"), (":p", "a", "owl:ObjectProperty"), (":q", "a", "owl:DatatypeProperty"), (":A", "rdfs:subClassOf", ":B"), (":p", "rdfs:domain", ":A"), (":q", "rdfs:domain", ":A"), (":q", "rdfs:range", "xsd:string"), (":p", "rdfs:range", ":B"), (":p", "rdfs:subPropertyOf", ":r"), (":A", "rdfs:label", '"é & <x>"')]
    owl_xml.write(spark.createDataFrame(triples, "s string, p string, o string"), f"{tmp_path}/x")
    assert rows(owl_xml.read(spark, f"{tmp_path}/x/*")) == sorted(triples)


def test_a_large_ontology_of_many_files(spark, tmp_path):
    t = spark.range(20_000).selectExpr("concat('#c', id) AS s", "'rdfs:subClassOf' AS p", "concat('#c', id DIV 2) AS o")
    owl_xml.write(t.repartition(6), f"{tmp_path}/x")
    assert len(list((tmp_path / "x" / "SubClassOf").glob("part-*"))) == 6
    assert owl_xml.read(spark, f"{tmp_path}/x/*").exceptAll(t).count() == 0 == t.exceptAll(owl_xml.read(spark, f"{tmp_path}/x/*")).count()
