"""A small documentation repo, written out here, for tests."""

from __future__ import annotations

import json
from functools import cache

REPO = "acme/docs"
FILES = {
    "index.md": "# Acme\n\nWelcome. See [install](guide/01-install.md) and [usage](guide/02-usage.md#run-it).\n\n## News\n\nRead [the log](changelog.md) or https://example.org/news #intro\n",
    "guide/01-install.md": "# Install\n\nInstall the tool. See [usage](02-usage.md) and [home](../index.md). #setup\n\n## Prerequisites\n\n**Runtime** — the program that runs the tool.\n\nSee [missing](gone.md) and [bad anchor](02-usage.md#nowhere).\n\n## Steps\n\n1. Run the installer\n2. Check the version\n3. Create a project\n\n```bash\n# fetch it\nacme install --all\n\nacme init\n```\n",
    "guide/02-usage.md": "# Usage\n\nNext: [tuning](03-tuning.md)\n\n## Run it\n\nRun the tool with a file. #setup #cli\n\n```python\n# load a client\nclient = acme.Client()\nclient.run()\n```\n\n## Errors\n\nWhat can go wrong?\n\nAn error is a failed call. See [prerequisites](01-install.md#prerequisites) and [self](#run-it) and [lost](#lost).\n",
    "guide/03-tuning.md": "# Tuning\n\n**Batch size** - how many rows a call takes.\n\n**Runtime** - named again.\n\n## API reference\n\nSee [api](../api/client.md) and [install](01-install.md#prerequisites).\n\n```sql\n-- count them\nselect count(*) from runs\n```\n",
    "api/client.md": "# Client\n\n## Client.run\n\nThe run method starts a job. Call it after setup. #api\n\n## Client.stop\n\nStop is the opposite of run. See [usage](../guide/02-usage.md).\n",
    "changelog.md": "---\nnext: index.md\nsources:\n  - src/client.py\n  - src/gone.py\n---\n# Changelog\n\n## 1.1\n\nFixed errors. #release\n\n## 1.0\n\nFirst release. #Release\n",
    "faq.md": "# FAQ\n\nWhat is it?\nHow do I install it?\nWhere are the logs?\n\nSee mailto:help@example.org and [log](/changelog.md).\n",
    "petstore.json": json.dumps({
        "openapi": "3.0.0", "info": {"title": "Pets", "version": "1"},
        "paths": {
            "/pets": {"get": {"operationId": "listPets", "tags": ["pets"], "summary": "All pets", "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Pet"}}}}}}}, "post": {"operationId": "addPet", "tags": ["pets"], "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/NewPet"}}}}, "responses": {"201": {"description": "made"}}}},
            "/owners/{id}": {"get": {"summary": "An owner", "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Owner"}}}}}}},
        },
        "components": {"schemas": {"Pet": {"type": "object", "properties": {"name": {"type": "string"}, "owner": {"$ref": "#/components/schemas/Owner"}}, "required": ["name"]}, "NewPet": {"allOf": [{"$ref": "#/components/schemas/Pet"}]}, "Owner": {"type": "object", "properties": {"address": {"$ref": "#/components/schemas/Address"}}}, "Address": {"type": "object"}}},
    }, indent=1),
}


@cache
def rows() -> list[dict]:
    from quire.sources.documents import split_document

    return [r for path, text in sorted(FILES.items()) for r in split_document(text, path, REPO)]


def sections(spark):
    """The repo's sections with what is derived at index time."""
    from quire.plans.pipeline import with_roles
    from quire.sources import documents

    raw = spark.createDataFrame([tuple(r[c.split()[0]] for c in documents.SECTION.split(", ")) for r in (dict(x, code_blocks=[tuple(b.values()) for b in x["code_blocks"]]) for x in rows())], documents.SECTION)
    return with_roles(documents.enrich(raw))
