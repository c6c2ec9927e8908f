"""Schemas of the tables that a scan writes, as DDL. Everything carries its repository."""

FILES = (
    "repo_id long, path string, name string, folder string, extension string, language string, size long, "
    "lines_total long, lines_code long, lines_comment long, lines_blank long, complexity long, imports long, exports long, "
    "func_count long, avg_func_len double, max_func_len long, avg_nesting double, max_nesting long, "
    "author string, commits long, first_commit_at timestamp, last_commit_at timestamp"
)
RAW_FILES = "repo_id long, path string, size long, content binary"
COMMITS = (
    "repo_id long, hash string, author string, email string, message string, date timestamp, "
    "files_changed long, insertions long, deletions long, is_merge boolean"
)
FILE_CHANGES = "repo_id long, hash string, path string, added long, deleted long"
BRANCHES = "repo_id long, name string, commit_hash string, is_current boolean"
TAGS = "repo_id long, name string, commit_hash string"
DEPENDENCIES = "repo_id long, file_path string, manager string, name string, version string, scope string"
IMPORT_EDGES = "repo_id long, from_file string, to_file string, kind string, resolved boolean"
REPOSITORY = "repo_id long, name string, path string, remote string, head_commit string, default_branch string, branch_count long, tag_count long"
