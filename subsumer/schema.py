"""Types of parsed ontologies, and the reserved names."""

TOP, BOTTOM = "owl:Thing", "owl:Nothing"
TOP_ID, BOTTOM_ID, FIRST_ID = 0, 1, 2

SYNONYM = "struct<text:string,scope:string,type:string,xrefs:array<string>>"
RELATIONSHIP = "struct<type:string,target_id:string,name:string>"
PART = "struct<relationship:string,target_id:string>"

HEADER = "format_version string, data_version string, ontology string"
TERMS = (
    "id string, name string, namespace string, definition string, is_obsolete boolean, comment string, subsets array<string>, "
    f"synonyms array<{SYNONYM}>, xrefs array<string>, alt_ids array<string>, relationships array<{RELATIONSHIP}>, "
    f"intersection_of array<{PART}>, properties map<string,string>"
)
TYPEDEFS = "id string, name string, is_transitive boolean, is_reflexive boolean"
AXIOMS = {
    "nf1": "sub long, sup long",
    "nf2": "l long, r long, sup long",
    "nf3": "sub long, role long, fill long",
    "nf4": "role long, fill long, sup long",
    "nf5": "sub long, sup long",
    "nf6": "r1 long, r2 long, sup long",
}
