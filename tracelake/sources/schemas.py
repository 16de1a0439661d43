"""Explicit schemas of what runs write; everything may be null, and what varies in type is a VARIANT."""

USAGE = "struct<prompt_tokens:long,completion_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
LOG_ENTRY = f"struct<after_step:int,invocation:int,feedback:string,original_feedback:string,suppressed:boolean,dedup_similarity:double,n_candidates:int,candidate_lengths:array<int>,select_strategy:string,usage:{USAGE}>"
INFO = (
    "struct<exit_status:string,submission:string,model_stats:struct<instance_cost:double,api_calls:long>,"
    "config:struct<agent:struct<prm_template:string,prm_interval:int,step_limit:int>,model:struct<model_name:string>,prm_model:struct<model_name:string>>,"
    f"prm_stats:struct<prm_cost:double,prm_feedback_history:array<struct<after_step:int,feedback:string>>,prm_feedback_log:array<{LOG_ENTRY}>>>"
)
MESSAGE = f"struct<role:string,content:variant,_supervisor:boolean,_supervisor_active:boolean,_prm_after_step:int,extra:struct<response:struct<usage:{USAGE}>>>"
TRAJECTORY = f"instance_id string, info {INFO}, messages array<{MESSAGE}>"
PREDICTIONS = "map<string,struct<model_name_or_path:string,instance_id:string,model_patch:string>>"
RESPONSE = "idx long, ground_truth string, response string, reasoning string, raw string"
SAMPLE = "messages array<struct<role:string,content:string>>"
